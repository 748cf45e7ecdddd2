"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are
additive, so a change is a signed delta: an insert adds a document and its
tokens, a delete subtracts them, a revised count adds the difference. A batch
of events is aggregated to one row per key, written to a staging folder and
renamed to a folder of its own under the batch's id; of several writers of one
batch, one succeeds. A batch that is whole already is left as it is, so retries
and replays change nothing, and a batch that was cut off is written anew.
compact() folds a fixed list of whole batches into a generation, which holds
their ids beside their totals; a batch committed meanwhile isn't in the list and
stays a batch. Folders that the generation before last has folded are deleted.

counts() makes the tokens that the query rolls up: with the BPE encoder of this
subpackage for .json vocabularies, with tiktoken for .tiktoken ones. Texts are
encoded whole, whatever their length; null texts have no tokens.

Nulls in source and language are values of their own; a null count is 0. Keys
whose documents and tokens are both 0 are left out of totals(). An empty batch
commits and adds nothing. Equal events of a batch count each.

Events are pre-aggregated before their shuffle, so hot keys cost one row per
task. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.llm import bpe
from assocframe.llm.text import slices

KEYS = ["source", "lang", "version"]
_SCHEMA = "source string, lang string, version string, docs long, tokens long"


def inserts(counts: DataFrame, version: str, tokens: str) -> DataFrame:
    return _events(counts, version, F.lit(1), F.coalesce(tokens, F.lit(0)))


def deletes(counts: DataFrame, version: str, tokens: str) -> DataFrame:
    return _events(counts, version, F.lit(-1), -F.coalesce(tokens, F.lit(0)))


def revisions(counts: DataFrame, version: str, old: str, new: str) -> DataFrame:
    return _events(counts, version, F.lit(0), F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0)))


def _events(counts: DataFrame, version: str, docs, tokens) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("version"), docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


class Rollup:
    """The rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _whole(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _names(self, kind: str, mark: str = "") -> list[str]:
        """Names of whole folders of a kind."""
        fs, p = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if self._whole(f"{self.path}/{kind}/{n}{mark}"))

    def _publish(self, staged: str, path: str) -> bool:
        """Rename a staging folder; false if another writer was first."""
        fs, p = self._fs(path)
        jvm, (_, source) = self.spark._jvm, self._fs(staged)
        fs.mkdirs(p.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(source, p, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._delete(staged)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Add a batch; false if it is there already."""
        path = f"{self.path}/batches/{batch}"
        if self._whole(path) or self._has_folded(self._generation(), batch):
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        events.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(staged)
        if not self._whole(path):
            self._delete(path)  # what was cut off
        return self._publish(staged, path)

    def _generation(self) -> str | None:
        return max(self._names("generations", "/totals"), default=None)

    def _ids(self, generation: str | None) -> DataFrame:
        """(batch, since): the batches in a generation and the one that folded each."""
        schema = "batch string, since string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/generations/{generation}/ids") if generation else self.spark.createDataFrame([], schema)

    def _has_folded(self, generation: str | None, batch: str) -> bool:
        return bool(self._ids(generation).where(F.col("batch") == batch).limit(1).count())

    def _open(self, generation: str | None) -> list[str]:
        """Whole batches that a generation doesn't hold: as many as lie between
        two calls of compact() at most."""
        names = self._names("batches")
        if not names or not generation:
            return names
        there = self.spark.createDataFrame([(n,) for n in names], "batch string")
        return sorted(r.batch for r in there.join(self._ids(generation), "batch", "left_anti").collect())

    def _sums(self, generation: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in batches] + ([f"{self.path}/generations/{generation}/totals"] if generation else [])
        parts = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return parts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches."""
        g = self._generation()
        return self._sums(g, self._open(g))

    def compact(self) -> bool:
        """Fold all batches that are whole now into a new generation; false if
        another writer was first."""
        g = self._generation()
        batches, name = self._open(g), f"{int(g or 0) + 1:08d}"
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        fresh = self.spark.createDataFrame([(b, name) for b in batches], "batch string, since string")
        self._ids(g).unionByName(fresh).coalesce(1).write.parquet(f"{staged}/ids")
        self._sums(g, batches).write.parquet(f"{staged}/totals")
        if not self._publish(staged, f"{self.path}/generations/{name}"):
            return False
        # a reader may still have the last generation's batches open, but not earlier ones'
        there = set(self._names("batches")) - set(batches)
        if there:
            old = self.spark.createDataFrame([(n,) for n in sorted(there)], "batch string").join(self._ids(g).where(F.col("since") < name), "batch", "left_semi")
            for r in old.collect():
                self._delete(f"{self.path}/batches/{r.batch}")
        return True


@lru_cache(2)
def _counter(path: str):
    """A function from texts to their numbers of tokens."""
    if not path.endswith(".tiktoken"):
        e = bpe.encoder(path)
        return lambda texts: np.diff(e.encode(texts)[1])
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: np.array([len(e.encode_ordinary(t)) for t in texts], np.int64)


def counts(docs: DataFrame, versions: dict[str, str], text: str = "text") -> DataFrame:
    """doc_id, source, lang and the number of tokens by each version's
    vocabulary (its path)."""
    keys = ["doc_id", "source", "lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                texts = part.column("_text").fill_null("").to_pylist()
                made = [pa.array(_counter(path)(texts), pa.int64()) for path in versions.values()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *made], names=[*keys, *versions])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{v}` long" for v in versions)])
    return docs.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
