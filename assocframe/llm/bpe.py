"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the neighbours
of the same word are looked up by binary search over the sorted pair keys, each
word's lowest rank is taken with one reduction, and all of that pair's
occurrences in the word are merged. Words that have nothing left to merge leave
the array. A word is encoded once; a bounded cache keeps the ids of those seen.
Where a round per merge would touch too much, in words of LONG bytes and more,
places wait in a queue by rank: each round takes the lowest rank of all these
words, merges its places, and looks up the pairs beside them only, so the whole
costs about its number of merges.

The vocabulary is a byte-level BPE file of the tokenizers library (its path is
a parameter). It is read where it is used, on each executor, so it must be
there; nothing of it is sent with the tasks.

Nulls and empty texts give no ids and decode to the empty text. Texts are
encoded whole, whatever their length; strings of special tokens in a text are
those tokens, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assocframe.llm.text import slices, within

#: How byte-level vocabularies of this family cut a text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a word from which rounds touch only what has changed.
LONG = 200
#: Words whose ids are remembered by a worker.
CACHE_WORDS = 150_000
#: Ids of them that are remembered.
CACHE_IDS = 1_500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary: merges as sorted pair keys, tokens as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * self.size
        for text, i in ids.items():
            tokens[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            tokens[i] = text.encode()
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = ids[c]
        keys, made = [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            keys.append(ids[a] * self.size + ids[b])
            made.append(ids[a + b])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(order, len(keys)).astype(np.int64)
        self.none = len(keys)
        self.made = np.array([*made, 0], np.int64)
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, flat, and each word's number of them."""
        long = np.array([len(w) >= LONG for w in words], bool)
        if not long.any():
            return self.merge_short(words)
        parts = [self.merge_short([w for w, x in zip(words, long, strict=True) if not x]), self.merge_long([w for w, x in zip(words, long, strict=True) if x])]
        count = np.zeros(len(words), np.int64)
        count[~long], count[long] = parts[0][1], parts[1][1]
        out, of_long = np.zeros(count.sum(), np.int64), np.repeat(long, count)
        out[~of_long], out[of_long] = parts[0][0], parts[1][0]
        return out, count

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, `none` where there is no such merge."""
        pair = left * self.size + right
        place = np.searchsorted(self.keys, pair)
        return np.where(self.keys[place] == pair, self.rank[place], self.none)

    def merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merge_short(), by a queue of ranks over linked symbols. Pairs of
        different words don't meet, so all words share the queue."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n, word = len(sym), np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(lengths) - 1
        after[last], before[last - lengths + 1] = -1, -1
        pair = np.full(n, self.none)  # the rank of each live symbol with the next one
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Look up the pairs that start at these places."""
            follow = after[at]
            rank = np.where(follow < 0, self.none, self.ranks(sym[at], sym[follow]))
            pair[at] = rank
            at, rank = at[rank < self.none], rank[rank < self.none]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
            for r, places in zip(rank[cut].tolist(), np.split(at, cut[1:]) if len(cut) else [], strict=True):
                if r in waiting:
                    waiting[r].append(places)
                else:
                    waiting[r] = [places]
                    heapq.heappush(queue, r)

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (pair[at] == r)]
            if not len(at):
                continue
            chained = np.append(False, after[at[:-1]] == at[1:])
            if chained.any():  # equal symbols in a row: every other place of a run, from its left
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            sym[at] = self.made[r]
            alive[gone] = False
            after[at] = after[gone]
            follow = after[at]
            before[follow[follow >= 0]] = at[follow >= 0]
            lead = before[at]
            wait(np.unique(np.concatenate([at, lead[lead >= 0]])))
        return sym[alive], np.bincount(word[alive], minlength=len(words))

    def merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() by rounds over all symbols of all words."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        out_sym, out_word = [], []
        while len(flat):
            rank = np.append(np.where(word[:-1] == word[1:], self.ranks(flat[:-1], flat[1:]), self.none), self.none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            live = least < self.none
            if not live.all():
                out_sym.append(flat[~live])
                out_word.append(word[~live])
                flat, word, rank, least = flat[live], word[live], rank[live], least[live]
                if not len(flat):
                    break
            hit = rank == least
            if (hit[1:] & hit[:-1]).any():  # equal symbols in a row: every other place of a run, from its left
                start = hit & ~np.append(False, hit[:-1])
                run_at = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
                hit &= (np.arange(len(hit)) - run_at) % 2 == 0
            at = np.flatnonzero(hit)
            flat[at] = self.made[rank[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            flat, word = flat[stay], word[stay]
        sym, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_sym, out_word))
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=len(words))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> Iterator[str]:
        """The text of each run of ids; broken UTF-8 becomes replacement characters."""
        size = self.lengths[ids]
        data = self.bytes[np.repeat(self.starts[ids], size) + within(size)].tobytes()
        ends = np.append(0, np.cumsum(size))[at]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield data[a:b].decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts, remembering words between batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        outer = self

        class Index(dict):
            def __missing__(self, word: str) -> int:
                i = self[word] = len(self)
                outer.fresh.append(word)
                return i

        self.index, self.fresh = Index(), []
        self.sizes, self.flat, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        ids, sizes = self.v.merge([w.encode("utf-8", "surrogatepass") for w in self.fresh])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        self.fresh = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and where each text's start (with the end)."""
        if len(self.index) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self.forget()
        v, find, get = self.v, self.v.words.findall, self.index.__getitem__
        codes, counts = [np.zeros(0, np.int64)], []
        for text in texts:
            n = 0
            for k, part in enumerate([text] if v.cut is None else v.cut.split(text)):
                if k % 2:  # what the cut has matched: a special token
                    codes.append(np.array([-1 - v.special[part]], np.int64))
                    n += 1
                else:
                    words = find(part)
                    codes.append(np.fromiter(map(get, words), np.int64, len(words)))
                    n += len(words)
            counts.append(n)
        if self.fresh:
            self.learn()
        code = np.concatenate(codes)
        size, start = np.ones(len(code), np.int64), np.zeros(len(code), np.int64)
        plain = code >= 0
        size[plain], start[plain] = self.sizes[code[plain]], self.starts[code[plain]]
        place = np.repeat(start, size) + within(size)
        ids = self.flat[place] if len(self.flat) else np.zeros(len(place), np.int64)
        until = np.append(0, np.cumsum(size))
        special = np.flatnonzero(~plain)
        ids[until[special]] = -1 - code[special]
        return ids, until[np.append(0, np.cumsum(np.array(counts, np.int64)))]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", slice_bytes: int = 1 << 20) -> DataFrame:
    """docs and an array of token ids for each text."""
    schema = f"{_ddl(docs, ids)} {ids} array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in slices(batch, text, slice_bytes):
                flat, at = e.encode(part.column(text).fill_null("").to_pylist())
                made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != ids]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), made], names=[*(n for n, _ in kept), ids])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs and the text of each array of ids (null: the empty text)."""
    schema = f"{_ddl(docs, text)} {text} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            flat, at = _lists(batch.column(ids))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text]
            made = pa.array(list(v.decode(flat, at)), pa.string())
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), made], names=[*(n for n, _ in kept), text])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20, ids: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and keep counts and digests: the ids as
    little-endian unsigned 32-bit integers, the decoded text in UTF-8. The ids
    themselves leave the worker only under a name given for their column."""
    kind = dict(docs.dtypes)[key]
    names = [key, *([ids] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, v = encoder(path), vocabulary(path)
        for batch in batches:
            for part in slices(batch, text, slice_bytes):
                flat, at = e.encode(part.column(text).fill_null("").to_pylist())
                raw = flat.astype("<u4").tobytes()
                told = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                back = [hashlib.sha256(t.encode()).hexdigest() for t in v.decode(flat, at)]
                made = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))] if ids else []
                yield pa.RecordBatch.from_arrays([part.column(key), *made, pa.array(np.diff(at), pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {f'`{ids}` array<int>, ' if ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, flat, and where each row's start."""
    values = column.flatten()
    at = np.append(0, np.cumsum(np.nan_to_num(np.asarray(column.value_lengths().fill_null(0)))).astype(np.int64))
    return np.asarray(values.cast(pa.int64())), at


def _ddl(docs: DataFrame, but: str) -> str:
    return "".join(f"`{n}` {t}, " for n, t in docs.dtypes if n != but)
