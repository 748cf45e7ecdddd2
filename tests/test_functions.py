"""Scalars against values fixed by definition, and properties."""

import math
import statistics
from statistics import NormalDist

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assocframe.functions import genomic as g, numeric as m, stats as s, text as t
from assocframe.operators import harmonise as h, prs, ranking as rk, report as rp
from assocframe.operators.ld import clump
from assocframe.sources import sinks, sniff


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_normal_quantile_and_erfc(spark):
    ps = [1e-12, 1e-5, 0.01, 0.2, 0.5, 0.7, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select(s.normal_quantile(F.col("p"))).collect()
    for p, r in zip(ps, rows, strict=True):
        assert r[0] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-9)
    xs = [0.0, 0.1, 0.7, 1.9, 2.4, 2.6, 4.0, 6.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(s.erfc(F.col("x"))).collect()
    for x, r in zip(xs, rows, strict=True):
        assert r[0] == pytest.approx(math.erfc(x), rel=1e-9)
    assert one(spark, s.normal_quantile(F.lit(0.0)), s.normal_quantile(F.lit(1.0))) == (None, None)
    assert one(spark, s.z_from_p(F.lit(1e-300)))[0] == pytest.approx(8.2, abs=0.1)  # saturates
    assert one(spark, s.z_from_p(F.lit(1e-20), exact_tail=True))[0] == pytest.approx(9.336, abs=1e-3)


def test_percent_moments_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, c double")
    r = df.agg(m.skewness(F.col("x")), m.kurtosis(F.col("x")), m.quantile(F.col("x"), 0.9), m.pearson(F.col("x"), F.col("c")), m.skewness(F.col("c"))).first()
    assert r[0] == pytest.approx(1.763633, abs=1e-6) and r[1] == pytest.approx(3.228, abs=1e-3) and r[2] == pytest.approx(7.9)
    assert r[3] is None and r[4] is None
    assert one(spark, m.pct(F.lit(3), F.lit(0)), m.effective_n(F.lit(100.0), F.lit(300.0))) == (0.0, 300.0)


def test_derived_error_from_interval(spark):
    none = F.lit(None).cast("double")
    assert one(spark, h.derive_se(none, none, none, F.lit(math.exp(1.96)), F.lit(math.exp(-1.96))))[0] == pytest.approx(1.0)


def test_alleles(spark):
    pair = lambda a, b: g.canonical_pair(F.lit(a), F.lit(b))
    assert set(one(spark, pair("A", "G"), pair("G", "A"), pair("T", "C"), pair("C", "T"))) == {"A/G"}
    assert one(spark, pair("ACT", "A"), g.canonical_pair(F.lit(None).cast("string"), F.lit("A")))[0] == "A/ACT"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ACGT"), st.sampled_from("ACGT")), min_size=1, max_size=20))
def test_pairs_don_t_depend_on_strand_or_order(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    c = g.complement
    bad = df.where((g.canonical_pair(F.col("a"), F.col("b")) != g.canonical_pair(F.col("b"), F.col("a"))) | (g.canonical_pair(F.col("a"), F.col("b")) != g.canonical_pair(c(F.col("a")), c(F.col("b")))) | (c(c(F.col("a"))) != F.col("a")))
    assert bad.count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(1e-6, 1), min_size=1, max_size=30))
def test_q_values_rise_with_p(spark, ps):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    q = [r["q"] for r in rk.bh_fdr(df, [], "p", "i").orderBy("p", "i").collect()]
    assert q == sorted(q) and all(0 < v <= 1 for v in q)


def test_fdr_of_four_and_null(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.04), (5, None)], "i int, p double")
    assert [r["q"] and round(r["q"], 9) for r in rk.bh_fdr(df, [], "p", "i").orderBy("i").collect()] == [0.04, 0.04, 0.04, 0.04, None]


def test_ranking_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 1), ("a", 2.0, 2.0, 2), ("b", 1.0, 5.0, 1), ("b", 1.0, 6.0, 2), ("c", 1.0, 1.0, 1)], "k string, y double, p double, i int")
    assert {r[0]: r[1] for r in rk.ndcg(df, ["k"], "y", "p", "i", 3).collect()} == {"a": 1.0, "b": None, "c": None}


def test_text(spark):
    r = one(spark, t.normal_header(F.lit(" [P-Value] ")), t.parse_size(F.lit("1.5K")), t.count_before(F.lit("1,234 cases"), "cases"), t.has_phrase(F.lit("Type 2 diabetes"), "diabetes"), t.is_missing(F.lit(" N/A ")), t.safe_name(F.lit("a b/c ")))
    assert r == ("p_value", 1536, 1234, True, True, "a_b_c")
    assert t._ratio("abc", "abd") == pytest.approx(66.666, abs=1e-2)


def test_bands_and_lists(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double")
    assert {r[0]: r[1] for r in rp.bands(df, "x", [2.0, 4.0]).collect()} == {"< 2": 1, ">= 4": 1, "missing": 1}


def test_clump_keeps_the_best_of_linked(spark):
    stats = spark.createDataFrame([("1", "a", 0.01), ("1", "b", 0.02), ("1", "c", 0.5)], "CHR string, SNPID string, P double")
    ld = spark.createDataFrame([("1", "a", "b", 9, 0.9)], "CHR string, s1 string, s2 string, n long, r2 double")
    assert {(r.SNPID, r.members) for r in clump(stats, ld).collect()} == {("a", 1), ("c", 0)}


def test_sources_and_sinks(spark, tmp_path):
    import gzip
    import zipfile

    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/a.txt.gz", "wt") as f:
        f.write("SNP\tP\nrs1\t0.5\n")
    with zipfile.ZipFile(tmp_path / "in/b.zip", "w") as z:
        z.writestr("small.txt", "x\n")
        z.writestr("large.txt", "SNP,CHR,P\nrs1,1,0.5\n")
    (tmp_path / "in/c.gz").write_text("plain text\n")
    found = {r.path.rsplit("/", 1)[1]: (r.compression, r.mismatch) for r in sniff.compression(spark, str(tmp_path / "in")).collect()}
    assert found == {"a.txt.gz": ("gzip", False), "b.zip": ("zip", False), "c.gz": ("gzip", True)}
    lines = sniff.sample_lines(spark, str(tmp_path / "in/[ab]*"), 5)
    assert {r.line for r in lines.where("line_no = 1").collect()} == {"SNP\tP", "SNP,CHR,P"}
    assert sorted(r.delimiter for r in sniff.delimiter(lines, ["path"]).collect()) == ["comma", "tab"]
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "i int, s string")
    out = str(tmp_path / "out")
    assert sinks.write(df, out) and not sinks.write(df, out) and sinks.write(df, out, "csv", force=True)
    assert sinks.markdown(df).splitlines()[2] == "| 1 | a\\|b |"
    assert "<td>a|b</td>" in sinks.as_html(df) and "tabular" in sinks.latex(df) and '"name": "i"' in sinks.metadata(df)


def test_stream_of_counts(spark, small, tmp_path):
    from assocframe.plans.views import VIEWS, view
    from assocframe.streaming import incremental

    v = view(spark, small, "variants").select("job_index", "P", "N")
    v.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    q = incremental.to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert "variants" in VIEWS
    assert sorted(spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()) == sorted(incremental.counts(v).collect())


def test_leakage_and_one_to_one(spark):
    from assocframe.operators import dataset as ds

    with pytest.raises(ValueError):
        ds.audit(spark.createDataFrame([("plink_auc",)], "feature string"))
    twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        ds.one_to_one(twice, twice, ["k"])


def test_joins_by_size_agree(spark):
    from assocframe.runtime import sized_join

    left = spark.range(100).selectExpr("id", "id % 3 AS k")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    small, large = (sorted(sized_join(left, right, ["k"], "left", ["id"], most=n).collect()) for n in (10, 1))
    assert small == large and len(small) == 100


def test_significance(spark):
    from assocframe.operators import tests_of_significance as ts

    assert ts.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert ts.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert ts.chi2_tail(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    x = [1.0, -2.0, 3.0, 4.0, 5.0, 0.0]
    df = spark.createDataFrame([("a", v) for v in x], "k string, x double")
    r = ts.signed_ranks(df, ["k"], "x").first()
    assert (r.n, r.w) == (5, 13.0)
    r = ts.one_sample_t(df, ["k"], "x").first()
    assert r.t == pytest.approx(statistics.mean(x) / (statistics.stdev(x) / len(x) ** 0.5)) and 0.1 < r.p < 0.2


def test_lift_of_edges(spark):
    from assocframe.operators import tests_of_significance as ts

    blocks = spark.createDataFrame([("1", 100, 2_500_000, "1", 5)], "CHR string, start long, end long, to_chr string, shift long")
    places = spark.createDataFrame([("1", 99), ("1", 100), ("1", 2_499_999), ("1", 2_500_000), ("2", 100)], "CHR string, POS long")
    assert {(r.CHR, r.POS): r.to_pos for r in ts.lift(places, blocks).collect()} == {("1", 99): None, ("1", 100): 105, ("1", 2_499_999): 2_500_004, ("1", 2_500_000): None, ("2", 100): None}


def test_ids_above_two_to_the_53_stay_whole(spark):
    from assocframe.operators import harmonise as h

    raw = spark.createDataFrame([("1:5:A:G", "9007199254740993", "0.5", "1200"), ("2:6:C:T", "-9007199254740995", "x", None)], "m string, id string, b string, n string")
    rows = h.standardise(raw, {"CHR": ["chrom"], "ROW": ["id"], "BETA": ["b"], "N": ["n"]}, "m").collect()
    assert [tuple(r) for r in rows] == [("1", "9007199254740993", 0.5, 1200), ("2", "-9007199254740995", None, None)]


def test_erfc_is_not_walked_row_by_row(spark):
    """Batches in place of a lambda for each term of each row; nulls stay null."""
    from pyspark.sql import functions as F

    from assocframe.functions import stats

    df = spark.createDataFrame([(0.0,), (3.0,), (None,)], "x double").select(stats.erfc(F.col("x")).alias("y"))
    assert "lambda" not in df._jdf.queryExecution().toString().lower()
    got = [r.y for r in df.collect()]
    assert got[0] == 1 and got[1] == pytest.approx(math.erfc(3), rel=1e-9) and got[2] is None


def test_only_rows_without_an_id_are_looked_up(spark):
    from assocframe.operators import harmonise

    v = spark.createDataFrame([("rs1", "1", 5, "A", "C"), (None, "1", 5, "A", "C"), (None, "1", 5, "C", "A"), (None, "1", 5, "G", "T"), (None, "2", 5, "A", "C")], "SNPID string, CHR string, POS int, EA string, NEA string")
    ref = spark.createDataFrame([("1", 5, "A", "C", "rs9"), ("1", 5, "A", "C", "rs8")], "CHR string, POS int, EA string, NEA string, ref_id string")
    got = {(r.SNPID, r.CHR, r.EA): (r.by_alleles, r.by_swap, r.by_place) for r in harmonise.matched(v, ref).collect()}
    assert got == {("rs1", "1", "A"): (None, None, None), (None, "1", "A"): ("rs8", None, "rs8"), (None, "1", "C"): (None, "rs8", "rs8"), (None, "1", "G"): (None, None, "rs8"), (None, "2", "A"): (None, None, None)}
    assert sorted(str(r.filled_id) for r in harmonise.fill_rsid(v, ref).collect()) == ["None", "rs1", "rs8", "rs8", "rs8"]
