"""What every operator shares: tables that cut lineage, joins that look at
sizes before they broadcast, and positions in a global order without a
single-task sort."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Most rows a side may have to be broadcast; wider rows should pass less.
BROADCAST_ROWS = 200_000
#: Copies of the small side, and so tasks for a hot key, when it isn't broadcast.
SALTS = 32

_own: dict[str, str] = {}
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.
    Where it is unset and the master is local, as in tests, a temporary one of
    this process; on a cluster that would be another folder on each machine."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="assocframe-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def materialise(df: DataFrame, tag: str, spark: SparkSession | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, in folders of the column `by` if
    given, and read it again: cuts the lineage and survives lost executors. What
    release() hasn't deleted goes when the driver ends."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_clear)
    _tables[path] = spark
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _delete(path: str) -> None:
    spark = _tables.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for path in list(_tables):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(path)


def release(*tables: DataFrame) -> None:
    """Delete tables of materialise() that no later read needs."""
    for t in tables:
        path = getattr(t, "__dict__", {}).get("_table")
        if path in _tables:
            _delete(path)


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", spread: list[str] | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large left side, whose keys may be hot, to a table. The right
    side, which should be materialised, is broadcast after a count has shown
    that it has at most `most` rows. Beyond that, keys are salted by a hash of
    the left columns in `spread` and the right side is repeated per salt, so
    that no key's rows meet in one task."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on, how)
    if not spread:
        return left.join(right, on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def spread_of(*cols: str, salts: int):
    """A bucket that depends on the columns' text alone, the same in any SQL:
    from the first seven hexadecimal digits of an MD5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long") % salts).cast("int")


def positions(df: DataFrame, group: list[str], cell: list[str], within: list, name: str = "position") -> DataFrame:
    """Add each row's place (from 1) in its group's order by (cell, within).
    Rows meet only with those of their own cell; what precedes a cell is a
    running sum over the counts of its group's cells, a table that must be
    bounded per group. Choose cells so that none holds much of the data."""
    counts = df.groupBy(*group, *cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, *cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group, *cell).orderBy(*within)).cast("long"))
    return inside.join(offsets, [*group, *cell]).withColumn(name, F.col("_before") + F.col("_nth")).drop("_before", "_nth")


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within, tables are handed to Python workers in batches of so many rows:
    for rows with large values, which count several times in a worker's and an
    executor's memory. Only what is materialised within is concerned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, what materialise() writes leaves no files of its shuffles on the executors'
    disks; else these stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that Python
    workers can import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="assocframe-zip-"))
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    with zipfile.ZipFile(at / "assocframe.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at / "assocframe.zip"))
    _shipped.add(app)


def shipping(query: Callable) -> Callable:
    """A query of (spark, sf_dir) that ships the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
