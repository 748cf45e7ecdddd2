"""Words and shingles of many texts at once, as numpy arrays over Arrow's
buffers: no Python object is made for a word.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is the
pattern [^\\x20\\x09-\\x0D]+. A word's hash is a polynomial over its bytes modulo
2**64, taken from one running sum, so a batch costs a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is taken alone.
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold: bool) -> np.ndarray:
    """A 64-bit value for each byte; with fold, A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if fold:
        v[65:91] = v[97:123]
    return v


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, for n places at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            if size > 4 * SLICE_BYTES:  # of a very long text; not kept
                return p, powers_of(_INVERSE, size)
            _powers[k] = p
    return _powers["up"], _powers["down"]


def powers_of(base: np.uint64, size: int) -> np.ndarray:
    p = np.full(size, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p, out=p)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts (with the end);
    null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each, one row at least."""
    _, at = buffers(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first
    word (with the end). Words are runs of bytes that `between` (of 256) hasn't."""
    n = len(data)
    word = ~between[data]
    edge = at[:-1][at[:-1] < n]
    before = np.empty(n, bool)
    before[1:] = word[:-1]
    before[edge] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[:-1] = word[1:]
    after[n - 1 : n] = False
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, by `values` (of byte_values)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words, in order, and for each text the
    index of its first (with the end). A text with fewer words, but some, has
    its whole sequence as one."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out_at = np.concatenate([[0], np.cumsum(made)])
    salts = mix(np.arange(11, 11 + n, dtype=np.uint64) * _BASE) | np.uint64(1)
    whole = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        whole += hashes[k : k + len(whole)] * salts[k]
    out = np.empty(out_at[-1], np.uint64)
    long = count >= n
    src = np.repeat(first[:-1][long], made[long]) + within(made[long])
    out[np.repeat(out_at[:-1][long], made[long]) + within(made[long])] = whole[src]
    for d in np.flatnonzero((count > 0) & ~long):
        h = hashes[first[d] : first[d + 1]]
        out[out_at[d]] = (h * salts[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))
    return mix(out), out_at


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
