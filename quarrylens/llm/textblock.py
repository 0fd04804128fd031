"""Vectorised text kernels over Arrow string columns: blocks, word spans and span hashes, without per-row Python."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RNG = np.random.RandomState(20240229)
BYTE64 = _RNG.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C15)
_POW = _UNPOW = np.ones(1, np.uint64)
PIECE = 1 << 17  # bytes hashed at once: the powers that are kept, for as long as a worker lives, are of four times as many at most
WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def col(name: str, of: str | None = None) -> Column:
    """The column of exactly this name, whatever signs are in it; of: the alias of its table."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def free(df: DataFrame, *names: str) -> list[str]:
    """Each of the names, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def renamed(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on: mapInArrow takes no name that holds a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def relieve() -> None:
    """Give memory that is free back to the system; a worker that outlives its task else keeps the most it ever had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def eased(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, which leaves no free memory behind in the worker."""

    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            relieve()

    return outer


def powers(n: int) -> np.ndarray:
    """MULT**0 .. MULT**(n-1) modulo 2**64, kept for later calls."""
    global _POW
    if n > len(_POW):
        size = max(n, 2 * len(_POW), 1024)
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, MULT, np.uint64)]))
    return _POW[:n]


def unpowers(n: int) -> np.ndarray:
    """The inverses of powers(n), kept for later calls."""
    global _UNPOW
    if n > len(_UNPOW):
        with np.errstate(over="ignore"):
            _UNPOW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * len(_UNPOW), 1024) - 1, pow(int(MULT), -1, 2**64), np.uint64)]))
    return _UNPOW[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty; offsets start at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch holding about `most` bytes of text; a longer text is a block of its own."""
    col = batch.column(batch.schema.get_field_index(text))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document indices of the words (runs free of white space) of a block."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data - np.uint8(9) > 4) & (data - np.uint8(28) > 4)  # not WS
    turns = np.flatnonzero(inside[1:] != inside[:-1])  # the first byte of a word, and the first one behind it, by turns
    starts, ends = turns[::2], turns[1::2]
    cuts = np.unique(offs[(offs > 0) & (offs < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):
        starts, ends = (np.insert(x, np.searchsorted(x, cuts), cuts) for x in (starts, ends))
    return starts, ends, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (none empty), equal for equal bytes wherever they lie."""
    lens = ends - starts
    upto = np.cumsum(lens)
    out = np.empty(len(starts), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            z = max(a + 1, int(np.searchsorted(upto, upto[a] - lens[a] + PIECE, side="right")))
            out[a:z] = _piece_hash(data, starts[a:z], ends[a:z], lens[a:z])
            a = z
        return mix(out + lens.astype(np.uint64) * MULT)


def _piece_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sums behind span_hash(), of spans of at most PIECE bytes in all or of a single longer one."""
    total = int(lens.sum())
    if total > PIECE:
        at = range(int(starts[0]), int(ends[0]), PIECE)
        each = (int((BYTE64[x] * powers(len(x))).sum()) for x in (data[k : min(k + PIECE, int(ends[0]))] for k in at))
        return np.array([sum(v * pow(int(MULT), k - at[0], 2**64) for k, v in zip(at, each)) % 2**64], np.uint64)
    base, stop = int(starts.min()), int(ends.max())
    if stop - base <= 2 * total:  # sums up to each byte: the difference of two, shifted back, is that of the span
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(BYTE64[data[base:stop]] * powers(stop - base), out=sums[1:])
        return (sums[ends - base] - sums[starts - base]) * unpowers(stop - base)[starts - base]
    first = np.cumsum(lens) - lens
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    return np.add.reduceat(BYTE64[data[within + np.repeat(starts, lens)]] * powers(int(lens.max()))[within], first)


def gram_hash(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams and the index of each one's first word; a document of fewer than n words gives one gram of all it has."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(words)
    at = np.arange(last)
    cut = np.flatnonzero(np.diff(docs)) + 1
    ends = np.repeat(np.concatenate([cut, [last]]), np.diff(np.concatenate([[0], cut, [last]])))
    starts = np.repeat(np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [last]])))
    keep = (at + n <= ends) | (at == starts)
    h = np.zeros(last, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(n, last)):
            some = h[: last - k]
            np.copyto(some, mix(some * MULT + words[k:] + np.uint64(k + 1)), where=at[k:] < ends[: last - k])
    return h[keep], at[keep]


def put_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def put_strings(data: np.ndarray, offs: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A string column from UTF-8 bytes and offsets."""
    out = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    out = out.cast(pa.string())
    return out if null is None or not null.any() else pc.if_else(pa.array(~null), out, pa.scalar(None, pa.string()))


def text_nulls(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return np.asarray(pc.is_null(batch.column(batch.schema.get_field_index(text))), bool)


class Lookup:
    """A fixed open-addressing table from non-negative int64 keys to int64 values, read a whole array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 6))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(keys))
        at = self.slot(keys)
        while len(left):  # of the keys that want a free slot, the first gets it; the others go on
            free = self.keys[at] < 0
            take, first = np.unique(at[free], return_index=True)
            got = left[free][first]
            self.keys[take], self.values[take] = keys[got], values[got]
            on = ~np.isin(left, got)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * MULT >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 where there is none."""
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], at[on]
        return out
