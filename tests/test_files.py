"""Files of all kinds, logs and saved models."""

import gzip
import io
import tarfile
import zipfile

import pytest

from assocframe.operators import ml, penalty
from assocframe.plans.views import view
from assocframe.runtime import ship
from assocframe.sources import logs, poke


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


LINES = ["SNP\tP", "rs1\t0.5", "é\t1"]
TEXT = "\n".join(LINES).encode()


def tarred(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    return out.getvalue()


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f"<sst {ns}><si><t>SNP</t></si><si><r><t>r</t></r><r><t>s,1</t></r></si></sst>"
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>P</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>0.5</v></c></row></sheetData></worksheet>'
    return zipped({"xl/workbook.xml": "<workbook/>", "xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": "<worksheet/>"})


def test_the_cascade(spark, tmp_path):
    """Each kind, right and wrong names, layers in layers, and broken files."""
    some = {"readme.txt": b"short", "data/gwas.tsv": TEXT}
    files = {
        "a.txt": (TEXT, "plain"), "b.tsv.gz": (gzip.compress(TEXT), "gzip"), "c.txt.gz": (gzip.compress(gzip.compress(TEXT)), "gzip+gzip"), "d.gz": (TEXT, "plain"), "e.csv": (gzip.compress(TEXT), "gzip"),
        "f.zip": (zipped(some), "zip"), "g.tar": (tarred(some), "tar"), "h.tgz": (tarred(some, "w:gz"), "gzip+tar"), "i.zip": (zipped({"x": b"", "y.gz": gzip.compress(TEXT * 1)}), "zip+gzip"), "j.tar": (tarred({"in.zip": zipped(some)}), "tar+zip"),
        "k.txt": (b"\xef\xbb\xbf" + TEXT.replace(b"\n", b"\r\n"), "plain"),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "book.xlsx").write_bytes(workbook())
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"x" * 100_000)[:60])
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 nothing")
    (tmp_path / "empty.txt").write_bytes(b"")
    got = {}
    for r in sorted(poke.poke(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.line_no)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.how, r.line, r.member))
    for name, (_, how) in files.items():
        assert [x[0] for x in got[name]] == [how] * 3 and [x[1] for x in got[name]] == LINES, name
    assert {x[2] for x in got["f.zip"]} == {x[2] for x in got["h.tgz"]} == {"data/gwas.tsv"}
    assert [x[:2] for x in got["book.xlsx"]] == [("xlsx", "SNP,,P"), ("xlsx", '"rs,1",,0.5')]
    assert got["cut.gz"][-1][1] is None and "EOFError" in got["cut.gz"][-1][2]
    assert got["bad.zip"] == [("unreadable", None, got["bad.zip"][0][2])] and "empty.txt" not in got


def test_long_members_come_in_batches(spark, tmp_path):
    (tmp_path / "long.gz").write_bytes(gzip.compress(b"\n".join(b"%d" % i for i in range(25_001))))
    got = poke.poke(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line for r in got] == [str(i) for i in range(25_001)] and got[-1].line_no == 25_001


def test_all_matches_of_a_line(spark):
    rows = [(1, "1. vcf [x y] (score: 0.9) and 2. plink2 (score: 0.75); 3. bad (score: )"), (1, "nothing"), (2, "10. ssf  (score:1.)"), (2, "Matching variants for hg19: num_hg19 = 1,234"), (2, "Matching variants for hg38:num_hg38=99"), (3, "Matching variants for hg38: num_hg38 = 0")]
    df = spark.createDataFrame(rows, "job int, value string")
    assert sorted(tuple(r) for r in logs.inferred_formats(df).collect()) == [(1, 1, "vcf", 0.9), (1, 2, "plink2", 0.75), (2, 10, "ssf", 1.0)]
    assert sorted(tuple(r) for r in logs.build_matches(df, ["job"]).collect()) == [(2, 1234, 99, round(99 / 1234, 6), "hg19"), (3, None, 0, None, None)]


def test_logs_are_read_whole(spark, tmp_path):
    (tmp_path / "a.log").write_text("1. vcf (score: 0.5)\n" * 3)
    (tmp_path / "b.log").write_text("x\n\n2. vcf (score: 0.5)")
    found = logs.inferred_formats(logs.lines(spark, str(tmp_path)))
    assert sorted((r.path[-5:], r.rank) for r in found.collect()) == [("a.log", 1)] * 3 + [("b.log", 2)]


@pytest.mark.parametrize("kind, options", [("ridge", {}), ("elastic_net", {}), ("forest", {"trees": 3})])
def test_a_saved_model_predicts_the_same(spark, small, tmp_path, kind, options):
    f, names = view(spark, small, "features"), ["f_size", "f_rate"]
    model = ml.pipeline(names, "target", kind, **options).fit(f)
    ml.dump(model, str(tmp_path / "m"), names, "target", kind=kind)
    back, features, label, told = ml.load(str(tmp_path / "m"))
    assert (features, label, told) == (names, "target", {"kind": kind})
    read = lambda m: [r.prediction for r in m.transform(f).orderBy("job_index").select("prediction").collect()]
    assert read(back) == read(model)
    if kind != "forest":
        assert isinstance(back.stages[-1], penalty.Fitted) and back.stages[-1].alpha == model.stages[-1].alpha
