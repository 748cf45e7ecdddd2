"""The registered queries on the small tables, and the pipeline stage by stage."""

import re
from collections import Counter

import pytest
from compare import rows_of, rows_of_sql

from assocframe.llm import exact_dedup, mixing, ngram_join, queries
from assocframe.runtime import ship

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    ship(spark)
    found = rows_of(QUERIES[name](spark, small))
    assert found[1]
    if name in SQL:
        assert found == rows_of_sql(duck, SQL[name])


def test_stages_take_effect(spark, small):
    """Each stage against the operator's own verdicts on its input."""
    import corpus_pipeline as p

    ship(spark)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in p.STAGES:
        out = stage(spark, docs, small).cache()
        rows = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "quality rules":
            want = Counter(r.doc_id for r in QUERIES["op1_quality_rules"](spark, small).where("kept").collect())
        elif name == "exact dedup":
            want = Counter(r.doc_id for r in exact_dedup.dedup(docs).where("kept").collect())
        elif name == "n-gram Jaccard join":
            want = Counter(r.doc_id for r in ngram_join.jaccard_components(docs, n=5, threshold=80).where("doc_id = component_id").collect())
        elif name == "mixing":
            want = Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
        else:
            want = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert rows == want, name
        if name != "BPE":
            assert out.columns == columns
        seen.append(sum(rows.values()))
        docs = out
    assert seen[0] < spark.read.parquet(f"{small}/documents.parquet").count() and seen[1] <= seen[0] and seen[2] <= seen[1]
    assert sum(1 for _ in p.run(spark, small).collect()) == seen[-1]


def test_pipeline_on_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline as p

    ship(spark)
    for k, docs in enumerate((odd, empty)):
        docs.write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        assert set(p.run(spark, str(tmp_path / str(k))).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"assocframe\.llm|from \.+llm", path.read_text()), path
