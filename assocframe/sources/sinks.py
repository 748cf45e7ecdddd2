"""Writers: tables, idempotent jobs, and small results as Markdown, LaTeX, HTML
and JSON."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession

#: Rows that a document may show; a table to be published is small.
MOST = 1_000


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write(df: DataFrame, path: str, kind: str = "parquet", force: bool = False, **options) -> bool:
    """Write a table unless it is there; with force, anew. False if left."""
    if exists(df.sparkSession, path) and not force:
        return False
    w = df.write.mode("overwrite").options(**options)
    {"parquet": w.parquet, "csv": lambda p: w.option("header", True).csv(p), "tsv": lambda p: w.option("header", True).option("sep", "\t").csv(p), "json": w.json, "orc": w.orc}[kind](path)
    return True


def sheets(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV tables in place of a workbook's sheets."""
    for name, df in tables.items():
        write(df, f"{path}/{name}", "csv", force=True)


def _rows(df: DataFrame) -> list[list[str]]:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows; write a table instead")
    return [["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(df: DataFrame) -> str:
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, _rows(df))])


def latex(df: DataFrame) -> str:
    safe = lambda s: "".join("\\" + ch if ch in "&%$#_{}" else ch for ch in s)
    body = " \\\\\n".join(" & ".join(map(safe, r)) for r in [df.columns, *_rows(df)])
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body} \\\\\n\\end{{tabular}}"


def as_html(df: DataFrame) -> str:
    row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>\n" + "\n".join([row("th", df.columns), *(row("td", r) for r in _rows(df))]) + "\n</table>"


def metadata(df: DataFrame, **more) -> str:
    return json.dumps({"columns": [{"name": n, "type": t} for n, t in df.dtypes], **more}, sort_keys=True)
