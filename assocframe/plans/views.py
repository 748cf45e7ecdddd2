"""Views over the star-schema tables that stand in for association files, with
one definition for both engines: DataFrames by selectExpr, and the same text as
common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WITHIN = "l_partkey * 10000000 + l_linenumber * 1000000 + (l_suppkey % 1000) * 1000 + CAST(floor(l_tax * 100) AS BIGINT) * 100 + CAST(l_quantity AS BIGINT)"

#: name: (table, select list, condition)
VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "variants": (
        "lineitem",
        {
            "job_index": "CAST(l_suppkey % 20 AS INT)",
            "row_id": f"CAST(l_orderkey AS BIGINT) * 1000000000000 + {_WITHIN}",
            "SNPID": "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN concat('chr', CAST(l_partkey % 22 + 1 AS VARCHAR(4)), ':', CAST(l_orderkey AS VARCHAR(20))) ELSE concat('rs', CAST(l_partkey AS VARCHAR(20))) END",
            "CHR": "CASE WHEN l_partkey % 24 + 1 = 23 THEN 'X' WHEN l_partkey % 24 + 1 = 24 THEN 'MT' ELSE CAST(l_partkey % 24 + 1 AS VARCHAR(4)) END",
            "POS": "CAST((l_partkey * 7919) % 50000000 + 1 AS BIGINT)",
            "EA": "substring('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1)",
            "NEA": "CASE WHEN l_orderkey % 97 = 0 THEN 'ACT' ELSE substring('CGTA', CAST((l_partkey + l_linenumber) % 4 AS INT) + 1, 1) END",
            "BETA": "l_discount - 0.05",
            "SE": "l_tax + 0.01",
            "P": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST((CAST(l_orderkey AS BIGINT) * 104729 + l_partkey * 31) % 1000000 AS DOUBLE) / 1000000.0 END",
            "EAF": "l_quantity / 100.0",
            "MAF": "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity / 100.0 END",
            "INFO": "CAST((CAST(l_orderkey AS BIGINT) * 31 + l_partkey) % 1013 AS DOUBLE) / 1000.0",
            '"OR"': "CASE WHEN l_orderkey % 17 = 0 THEN 0.0 ELSE 1.0 + (l_discount - 0.05) * 4.0 END",
            "Z": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE (l_discount - 0.05) / (l_tax + 0.01) END",
            "N": "CAST(1000 + l_suppkey % 50 AS DOUBLE)",
            "N_CASES": "CAST(400 + l_suppkey % 20 AS DOUBLE)",
            "N_CONTROLS": "CAST(600 + l_suppkey % 30 AS DOUBLE)",
        },
        "",
    ),
    "target": (
        "part",
        {
            "CHR": "CASE WHEN p_partkey % 24 + 1 = 23 THEN 'X' WHEN p_partkey % 24 + 1 = 24 THEN 'MT' ELSE CAST(p_partkey % 24 + 1 AS VARCHAR(4)) END",
            "SNPID": "concat('rs', CAST(p_partkey AS VARCHAR(20)))",
            "POS": "CAST((p_partkey * 7919) % 50000000 + 1 AS BIGINT)",
            "A1": "substring('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1)",
            "A2": "substring('CGTA', CAST(p_size % 4 AS INT) + 1, 1)",
            "MAF": "CAST(p_size AS DOUBLE) / 100.0",
            "BETA": "CAST(p_partkey % 200 AS DOUBLE) / 1000.0 - 0.1",
            "P": "CAST(p_partkey % 999 + 1 AS DOUBLE) / 1000.0",
        },
        "",
    ),
    "jobs": (
        "supplier",
        {"job_index": "CAST(s_suppkey AS INT)", "phenotype": "concat('pheno_', CAST(s_nationkey % 5 AS VARCHAR(4)))", "accession": "concat('ACC', CAST(s_suppkey AS VARCHAR(20)))", "perf": "s_acctbal"},
        "s_suppkey < 20",
    ),
    "samples": (
        "customer",
        {"FID": "CAST(c_nationkey AS VARCHAR(20))", "IID": "CAST(c_custkey AS VARCHAR(20))", "SEX": "CAST(1 + c_custkey % 2 AS INT)", "PHENO": "CASE WHEN c_acctbal < 0 THEN -9.0 ELSE CAST(1 + c_nationkey % 2 AS DOUBLE) END", "AGE": "CAST(20 + c_custkey % 60 AS DOUBLE)"},
        "",
    ),
    "folds": (
        "orders",
        {
            "job_index": "CAST(o_custkey % 20 AS INT)",
            "fold": "CAST(o_orderkey % 5 AS INT)",
            "label": "o_orderpriority",
            "pvalue": "CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) / 10.0",
            "train": "0.5 + CAST(o_orderkey % 401 AS DOUBLE) / 1000.0",
            "test": "0.5 + CAST((o_orderkey * 7) % 301 AS DOUBLE) / 1000.0",
        },
        "",
    ),
    "features": (
        "supplier",
        {
            "job_index": "CAST(s_suppkey AS INT)",
            "phenotype": "concat('pheno_', CAST(s_nationkey % 5 AS VARCHAR(4)))",
            "accession": "concat('ACC', CAST(s_suppkey AS VARCHAR(20)))",
            "f_size": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST((s_suppkey * 37) % 101 AS DOUBLE) END",
            "f_rate": "CAST((s_suppkey * 53) % 89 AS DOUBLE) / 89.0",
            "f_const": "CAST(1 AS DOUBLE)",
            "f_sparse": "CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS DOUBLE) END",
            "target": "s_acctbal / 10000.0",
            "predicted": "(s_acctbal + CAST((s_suppkey * 7919) % 3000 AS DOUBLE)) / 10000.0",
            "p_value": "CAST((s_suppkey * 7919) % 1000 + 1 AS DOUBLE) / 100000.0",
        },
        "",
    ),
}


#: For columns that rows are only ordered by: the same order in two BIGINTs. One overflows
#: where orders' keys reach 9,223,372.
ORDERS = {"variants": {"row_id": f"struct(l_orderkey + ({_WITHIN} - pmod({_WITHIN}, 1000000000000)) div 1000000000000 AS high, pmod({_WITHIN}, 1000000000000) AS low)"}}


def ordered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """view() for queries that don't return what ORDERS has."""
    return view(spark, sf_dir, name, ORDERS[name])


def view(spark: SparkSession, sf_dir: str, name: str, other: dict[str, str] | None = None) -> DataFrame:
    """A view; `other` has expressions that take the place of its own."""
    table, columns, where = VIEWS[name]
    columns = columns | (other or {})
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.where(where) if where else df
    return df.selectExpr(*[f"{e} AS {n.replace(chr(34), chr(96))}" for n, e in columns.items()])


def sql(body: str) -> str:
    """body with the views that it names as common table expressions."""
    used = [n for n in VIEWS if f" {n}" in body or f"\n{n}" in body]
    ctes = []
    for n in used:
        table, columns, where = VIEWS[n]
        ctes.append(f"{n} AS (SELECT {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM {table}{' WHERE ' + where if where else ''})")
    head, rest = ("WITH ", body.strip())
    if rest.upper().startswith("WITH "):
        rest = rest[5:]
        return head + ",\n".join([*ctes, rest])
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + rest
