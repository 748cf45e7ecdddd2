"""Spellings and what they are read as, one by one."""

import pytest
from pyspark.sql import functions as F

from assocframe.functions import genomic as g, numeric as m, text as t
from assocframe.operators import dataset as ds, harmonise as h
from assocframe.sources import catalog, plink, sniff

CHR = [("chr1", "1"), ("CHR2", "2"), ("23", "X"), ("24", "Y"), ("25", "MT"), ("M", "MT"), (" 7 ", "7")]
POS = [("1,000", 1000), ("12.0", 12), ("-3", None), ("x", None), ("5", 5)]
ALLELES = [("A", "G", "A", "G", "direct_match"), ("A", "G", "G", "A", "flip_match"), ("A", "G", "T", "C", "strand_match"), ("A", "G", "C", "T", "strand_flip_match"), ("A", "T", "A", "T", "palindromic_ambiguous"), ("A", "G", "A", "C", "mismatch"), ("-", "G", "A", "G", "missing_allele")]
BUILDS = [("GRCh37", "hg19"), ("hg38", "hg38"), ("build37", "hg19"), ("b38", "hg38"), ("other", "unknown")]
HEADERS = [("Effect_Allele", "A1"), ("P-value", "P"), ("CHR", "CHR"), ("b", "BP"), ("markername", "SNP"), ("beta", "BETA"), ("odd one", "UNMAPPED"), ("Standard.Error", "SE"), ("[eaf]", "EAF")]
FILES = [(1, ("SNP", "CHR", "BP", "A1", "A2", "BETA", "SE", "P", "N")), (2, ("rsid", "effect_allele", "odds_ratio")), (3, ("chr", "position", "ea", "z", "pval"))]
SIZES = [("12K", 12288), ("3.5M", 3670016), ("1G", 1073741824), ("77", 77), ("-", None)]
SAMPLES = [("1,234 European ancestry cases, 5,000 European ancestry controls", 1234, 5000, 6234), ("up to 20,000 individuals", None, None, 20000), ("no numbers", None, None, None)]
LABELS = [("Pt_0.05", 0.05), ("Pt_1e-05", 0.00001), ("other", None)]
NUMBERS = [("1,234", 1234.0), ("12%", 12.0), ("Yes", 1.0), ("false", 0.0), ("nan", None), ("1.0d", None), ("1e-3", 0.001), ("", None), ("inf", None)]
IDS = [("chr1:1000:A:G", "1", 1000, "A", "G", None), ("rs12", None, None, None, None, "rs12"), ("X_55", "X", 55, None, None, None)]
LINES = [(1, 1, "# note"), (1, 2, "SNP\tCHR\tP"), (1, 3, "rs1\t1\t0.5"), (2, 1, "snp,chr,bp,p"), (2, 2, "rs1,1,5,0.1"), (3, 1, "1 2 3"), (3, 2, "4 5 6")]


def read(spark, raws, made):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    return [r[0] for r in df.select("i", made(F.col("raw")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize("pairs, made", [(CHR, g.normal_chr), (POS, g.normal_pos), (BUILDS, g.build_name), (SIZES, t.parse_size), (LABELS, plink.threshold_of), (NUMBERS, m.clean_number)])
def test_spellings(spark, pairs, made):
    assert read(spark, [a for a, _ in pairs], made) == [b for _, b in pairs]


def test_alleles(spark):
    df = spark.createDataFrame(ALLELES, "ea string, nea string, a1 string, a2 string, want string")
    got = df.select("want", g.match_status(*[g.normal_allele(F.col(c)) for c in ("ea", "nea", "a1", "a2")]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_compound_ids(spark):
    df = spark.createDataFrame([(r[0],) for r in IDS], "id string")
    assert {tuple(r) for r in df.select("id", *[c.alias(k) for k, c in h.parse_compound(F.col("id")).items()]).collect()} == set(IDS)


def test_descriptions(spark):
    df = catalog.counted(spark.createDataFrame([(x[0],) for x in SAMPLES], "description string"), "description")
    assert {tuple(r) for r in df.select("description", "cases", "controls", "samples").collect()} == set(SAMPLES)


def test_headers_and_files(spark):
    got = h.map_headers(spark.createDataFrame([(a,) for a, _ in HEADERS], "raw_header string"))
    assert {(r.raw_header, r.standard) for r in got.collect()} == set(HEADERS)
    rows = spark.createDataFrame([(i, c) for i, cols in FILES for c in cols], "file int, raw_header string")
    flags = {(r.file, r.columns, r.mapped, r.has_effect, r.prs_minimum, r.ldsc_minimum) for r in h.coverage_flags(h.map_headers(rows), ["file"]).collect()}
    assert flags == {(1, 9, 9, True, True, True), (2, 3, 3, True, False, False), (3, 5, 5, True, True, False)}


def test_lines(spark):
    df = spark.createDataFrame(LINES, "file int, n int, line string")
    assert {tuple(r) for r in sniff.delimiter(df, ["file"]).collect()} == {(1, "tab", 3), (2, "comma", 4), (3, "space", 3)}
    assert {tuple(r) for r in sniff.header(df, ["file"], "n").drop("header").collect()} == {(1, True, 2, 1), (2, True, 1, 0), (3, False, None, 0)}


def test_leaks_and_families(spark):
    df = spark.createDataFrame([("feature9_clump_r2",), ("median_info",), ("plink_Test_auc",), ("f1_score",), ("n_spread",), ("Generalisation_Gap",)], "feature string")
    assert {r.feature for r in ds.leakage(df).where("leaky").collect()} == {"feature9_clump_r2", "plink_Test_auc", "f1_score", "Generalisation_Gap"}
    assert {tuple(r) for r in ds.families(df, "feature").collect()} == {("feature9", 1), ("median", 1), ("plink", 1), ("f1", 1), ("n", 1), ("Generalisation", 1)}


def test_qualified_headers(spark):
    pairs = [("pvalue_plink", "P"), ("ff.random.pval", "P"), ("__odds_ratio__", "OR"), ("SE_saige", "SE"), ("standard_error_site2", "SE"), ("EFFECT_ALLELE_FREQUENCY_CASES", "EAF"), ("Direction", "DIRECTION"), ("chr:position", "CHR"), ("MarkerName", "SNP"), ("MAF_hapmap", "MAF"), ("stderr females", "SE"), ("base_pair_location_grch38", "BP"), ("n_total_cases", "UNMAPPED"), ("n_samples_study_level", "N"), ("made up", "UNMAPPED"), ("all", "UNMAPPED")]
    rows = spark.createDataFrame([(a,) for a, _ in pairs], "raw_header string")
    assert {(r.raw_header, r.standard) for r in h.map_headers(rows).collect()} == set(pairs)
    assert {r.raw_header for r in h.map_headers(rows, qualifier=None).where("identified").collect()} == {"__odds_ratio__", "Direction", "chr:position", "MarkerName"}
    own = h.map_headers(rows, table={"X": ("made_up",)})
    assert {(r.raw_header, r.standard) for r in own.where("identified").collect()} == {("made up", "X")}
