"""What kind of text a file is: compression, delimiter, header and row count.

Files are read by Spark's own readers: binaryFile for magic bytes and members
of archives, text for lines; nothing is opened on the driver."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Delimiters that are tried, in this order; the first wins ties (fixed values).
DELIMITERS = (("tab", "\t"), ("comma", ","), ("semicolon", ";"), ("pipe", "|"), ("space", " "))


def by_extension(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"\.tar\.gz$|\.tgz$"), "tar.gz").when(p.endswith(".tar"), "tar").when(p.endswith(".gz") | p.endswith(".bgz"), "gzip").when(p.endswith(".zip"), "zip").otherwise("none")


def by_magic(content: Column) -> Column:
    hexed = lambda a, n: F.hex(F.substring(content, a, n))
    return F.when(hexed(1, 2) == "1F8B", "gzip").when(hexed(1, 4) == "504B0304", "zip").when(hexed(258, 5) == "7573746172", "tar").otherwise("none")


def compression(spark: SparkSession, path: str) -> DataFrame:
    """path, length, what the extension and the first bytes say, and whether
    they differ."""
    f = spark.read.format("binaryFile").load(path)
    ext, magic = by_extension(F.col("path")), by_magic(F.col("content"))
    same = (ext == magic) | ((ext == "tar.gz") & (magic == "gzip"))
    return f.select("path", "length", ext.alias("extension"), magic.alias("magic"), F.when(magic != "none", magic).otherwise(ext).alias("compression"), (~same).alias("mismatch"))


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def sample_lines(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """(path, line_no, line): the first lines of each file; of an archive, of its
    largest member. Files are read whole by one task each, as archives must be."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                data: io.IOBase = io.BytesIO(content)
                if content[:2] == b"\x1f\x8b":
                    data = gzip.GzipFile(fileobj=data)
                if content[:4] == b"PK\x03\x04":
                    z = zipfile.ZipFile(data)
                    data = z.open(max(z.infolist(), key=lambda i: i.file_size))
                elif path_.lower().endswith((".tar", ".tgz", ".tar.gz")):
                    t = tarfile.open(fileobj=data)
                    data = t.extractfile(max((m for m in t.getmembers() if m.isfile()), key=lambda m: m.size))
                lines = [x.decode("utf-8", "replace").rstrip("\r\n") for _, x in zip(range(most), data, strict=False)]
                yield pd.DataFrame({"path": path_, "line_no": range(1, len(lines) + 1), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(first, "path string, line_no long, line string")


def delimiter(lines: DataFrame, key: list[str], line: str = "line", least: int = 2) -> DataFrame:
    """Per key the delimiter with the largest median number of fields."""
    sizes = F.array(*[F.struct(F.lit(-i).alias("order"), F.lit(n).alias("name"), F.size(F.split(F.col(line), F.concat(F.lit("\\Q"), F.lit(d), F.lit("\\E")))).alias("fields")) for i, (n, d) in enumerate(DELIMITERS)])
    text = lines.where((F.trim(line) != "") & ~F.col(line).startswith("#"))
    each = text.select(*key, F.explode(sizes).alias("s")).select(*key, "s.*")
    medians = each.groupBy(*key, "order", "name").agg(F.sort_array(F.collect_list("fields")).alias("f")).withColumn("fields", F.expr("f[size(f) div 2]"))
    best = medians.groupBy(*key).agg(F.max(F.struct("fields", "order", "name")).alias("b"))
    return best.select(*key, F.when(F.col("b.fields") >= least, F.col("b.name")).otherwise("unknown").alias("delimiter"), F.col("b.fields").alias("fields"))


def header(lines: DataFrame, key: list[str], order: str, line: str = "line", split_by: str = "[\t,;| ]") -> DataFrame:
    """Per key the first line with two tokens or more, half of them no numbers,
    and how many comment lines come before it."""
    tokens = F.filter(F.split(F.trim(line), split_by), lambda x: x != "")
    words = F.size(F.filter(tokens, lambda x: x.try_cast("double").isNull()))
    marked = lines.select(*key, order, tokens.alias("tokens"), F.col(line).startswith("#").alias("comment"), ((F.size(tokens) >= 2) & (2 * words >= F.size(tokens)) & ~F.col(line).startswith("#")).alias("ok"))
    first = marked.groupBy(*key).agg(F.min(F.when(F.col("ok"), F.struct(order, "tokens"))).alias("h"))
    before = marked.join(first, key).where(F.col("h").isNull() | (F.col(order) < F.col(f"h.{order}"))).groupBy(*key).agg(F.count_if("comment").alias("comments"))
    return first.join(before, key, "left").select(*key, F.col("h").isNotNull().alias("has_header"), F.col(f"h.{order}").alias("header_line"), F.coalesce("comments", F.lit(0)).alias("comments"), F.col("h.tokens").alias("header"))


def count_rows(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def read_complete(spark: SparkSession, path: str, sep: str, comment: str = "#") -> DataFrame:
    """All columns as text; the types come from the columns' meaning later."""
    return spark.read.options(sep=sep, header=True, comment=comment, inferSchema=False).csv(path)


def manifest(files: DataFrame, pattern: str = r"(?i)\.(txt|tsv|csv)(\.gz)?$", skip: str = "(?i)readme|md5|meta") -> DataFrame:
    """job_index, from 1 in order of path, of the files that hold data."""
    ok = files.where(F.col("path").rlike(pattern) & ~F.col("path").rlike(skip))
    return ok.withColumn("job_index", F.row_number().over(Window.orderBy("path"))).select("job_index", "path", "length")


def best_candidate(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Per study the file with the best score: harmonised, compressed text and
    larger ones first; ties by name."""
    n = F.lower("candidate_name")
    score = 100 * n.contains("harmonised").cast("int") + 20 * n.rlike(r"\.(tsv|txt|csv)").cast("int") + 10 * n.rlike(r"\.gz$").cast("int") - 50 * n.rlike("readme|md5|yaml|log").cast("int")
    w = Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("candidate_size"), "candidate_name")
    return candidates.withColumn("score", score).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
