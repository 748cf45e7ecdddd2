"""Files of unknown kind, opened layer by layer: what the first bytes are decides, not
the name. Gzip (also twice), zip and tar are followed to their largest member, a
workbook to its first sheet, until there is text. Members are read as streams, in
batches of lines, so a task holds an archive as it lies in the store and a batch."""

from __future__ import annotations

import csv
import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from assocframe.runtime import batches_of, materialise

#: Lines of one batch, and layers that are opened at most.
LINES, LAYERS = 10_000, 6
_FAILS = (OSError, EOFError, zlib.error, zipfile.BadZipFile, tarfile.TarError, ElementTree.ParseError, KeyError, ValueError)
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORKBOOK = "xl/workbook.xml"

#: Opens a layer anew from its start.
Opener = Callable[[], io.BufferedIOBase]


class _Forward(io.RawIOBase):
    """A stream that is only read forwards, whatever it says of itself."""

    def __init__(self, inner):
        self.inner = inner

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.inner.read(len(into))
        into[: len(data)] = data
        return len(data)


def _buffered(raw) -> io.BufferedReader:
    return io.BufferedReader(_Forward(raw), 1 << 16)


def _is_tar(head: bytes) -> bool:
    return head[257:262] == b"ustar"


def _of_gzip(inner: Opener) -> tuple[str, Opener]:
    return "", lambda: _buffered(gzip.GzipFile(fileobj=inner()))


def _of_zip(data: bytes) -> tuple[str, Opener]:
    z = zipfile.ZipFile(io.BytesIO(data))
    files = [i for i in z.infolist() if not i.is_dir()]
    best = max(files, key=lambda i: (i.file_size, i.filename))
    return best.filename, lambda: _buffered(z.open(best))


def _of_tar(inner: Opener) -> tuple[str, Opener]:
    """Two passes over the stream: one for the sizes, one up to the member."""
    with tarfile.open(fileobj=inner(), mode="r|") as t:
        best = max((m.size, m.name) for m in t if m.isfile())[1]

    def start() -> io.BufferedReader:
        t = tarfile.open(fileobj=inner(), mode="r|")
        return _buffered(next(t.extractfile(m) for m in t if m.isfile() and m.name == best))

    return best, start


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """The cells of a workbook's first sheet, row by row; gaps are empty."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
            if e.tag == _SHEET + "si":
                shared.append("".join(t.text or "" for t in e.iter(_SHEET + "t")))
                e.clear()
    first = min((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
    for _, e in ElementTree.iterparse(z.open(first)):
        if e.tag != _SHEET + "row":
            continue
        cells: list[str] = []
        for c in e.iter(_SHEET + "c"):
            at = 0
            for ch in filter(str.isalpha, c.get("r") or ""):
                at = at * 26 + ord(ch.upper()) - 64
            value, inline = c.find(_SHEET + "v"), c.find(_SHEET + "is")
            text = "".join(t.text or "" for t in inline.iter(_SHEET + "t")) if inline is not None else (value.text or "") if value is not None else ""
            if c.get("t") == "s" and text:
                text = shared[int(text)]
            cells += [""] * (at - 1 - len(cells)) if at else []
            cells.append(text)
        yield cells
        e.clear()


def _as_csv(rows: Iterator[list[str]]) -> Iterator[str]:
    for r in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        yield out.getvalue()


def opened(content: bytes) -> tuple[str, str, Iterator[str]]:
    """(how, member, lines) of a file: the layers that were opened, the last member's
    name, and its lines without their ends."""
    how, member, start = [], "", (lambda: _buffered(io.BytesIO(content)))
    whole: bytes | None = content
    for _ in range(LAYERS):
        head = start().peek(512)[:512]
        if head[:2] == b"\x1f\x8b":
            how.append("gzip")
            _, start = _of_gzip(start)
            whole = None
        elif head[:4] == b"PK\x03\x04":
            data = whole if whole is not None else start().read()
            if _WORKBOOK in zipfile.ZipFile(io.BytesIO(data)).namelist():
                return "+".join([*how, "xlsx"]), member, _as_csv(sheet_rows(data))
            how.append("zip")
            member, start = _of_zip(data)
            whole = None
        elif _is_tar(head):
            how.append("tar")
            member, start = _of_tar(start)
            whole = None
        else:
            break
    text = io.TextIOWrapper(start(), encoding="utf-8-sig", errors="replace", newline="\n")
    return "+".join(how) or "plain", member, (line.rstrip("\r\n") for line in text)


def poke(spark: SparkSession, path: str) -> DataFrame:
    """(path, how, member, line_no, line) of all lines of each file. A file that can't be
    opened, or not to its end, has a last row whose line is null and whose member says
    why; empty files have no rows. The lines are written once, as the cascade is dear."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                how, at = "unreadable", 0
                try:
                    how, member, lines = opened(content)
                    held: list[str] = []
                    for line in lines:
                        held.append(line)
                        if len(held) == LINES:
                            yield _rows(name, how, member, at, held)
                            at, held = at + len(held), []
                    if held:
                        yield _rows(name, how, member, at, held)
                except _FAILS as e:
                    yield _rows(name, how, f"{type(e).__name__}: {e}", at, [None])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    with batches_of(spark, 1):
        return materialise(files.mapInPandas(run, "path string, how string, member string, line_no long, line string"), "poked")


def _rows(name: str, how: str, member: str, at: int, lines: list) -> pd.DataFrame:
    return pd.DataFrame({"path": name, "how": how, "member": member, "line_no": range(at + 1, at + len(lines) + 1), "line": lines})
