"""An extension: file profiles over arriving files, as streams.

Additive parts of a profile (counts and sums) are kept per file by Structured
Streaming; each micro-batch adds to them, and a batch that is replayed after a
failure isn't added twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(stream: DataFrame, key: str = "job_index") -> DataFrame:
    """Running counts per file, for a stream or a table of variants."""
    p = F.col("P")
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count(p).alias("with_p"), F.count_if(p < 5e-8).alias("genome_wide"), F.count_if(p < 1e-5).alias("suggestive"), F.sum(F.col("N").cast("double")).alias("sum_n"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type and window of time; rows later than `late`
    are left out of windows that are closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing running counts, a whole table per micro-batch, to a folder
    per batch; a replayed batch overwrites its own folder."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counts(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
