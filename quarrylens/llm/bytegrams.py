"""Counts of byte n-grams over a corpus: exact keys of up to seven bytes, counted a block at a time and summed by Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.textblock import blocks, eased, raw
from quarrylens.runtime import ship

BEGIN, END = 2, 3  # bytes before and after a text
HELD = 1 << 21


def gram_keys(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each byte of each text and at its end, and how many each text has (its bytes and one)."""
    lens = np.diff(offs)
    count = len(lens)
    row = np.repeat(np.arange(count), lens)
    padded = np.full(len(data) + count * n, BEGIN, np.uint8)
    padded[np.arange(len(data)) + row * n + n - 1] = data
    last = offs[1:] + np.arange(1, count + 1) * n - 1
    padded[last] = END
    key = np.zeros(max(0, len(padded) - n + 1), np.int64)
    for j in range(n):
        key = (key << 8) | padded[j : j + len(key)]
    # windows that begin inside a text's own padding or body, not those that run over its end
    ok = np.ones(len(key), bool)
    for j in range(1, n):
        at = last[:-1] - n + 1 + j
        ok[at[at < len(key)]] = False
    return key[ok], lens + 1


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def gram_counts(docs: DataFrame, n: int, text: str = "text", by: str | None = None) -> DataFrame:
    """(part, key, n): how often each n-gram occurs, for each value of the column `by` (null is "") or for all. Null texts have none."""
    ship(docs.sparkSession)
    part = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = docs.where(F.col(text).isNotNull()).select(part.alias("part"), F.col(text).alias("text"))

    def run(batches):
        held: dict[str, tuple[list, list]] = {}

        def out(name):
            k, c = _sums(*held.pop(name))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(c)], ["part", "key", "n"])

        for batch in batches:
            for b in blocks(batch, "text"):
                for name in pc.unique(b.column(0)).to_pylist():
                    col = b.column(1).filter(pc.equal(b.column(0), name))
                    k, c = np.unique(gram_keys(*raw(col), n)[0], return_counts=True)
                    keys, counts = held.setdefault(name, ([], []))
                    keys.append(k)
                    counts.append(c)
                    if sum(map(len, keys)) > HELD:
                        k, c = _sums(keys, counts)
                        held[name] = ([k], [c])
                        if len(k) > HELD // 2:
                            yield out(name)
        for name in list(held):
            yield out(name)

    return rows.mapInArrow(eased(run), "part string, key bigint, n bigint").groupBy("part", "key").agg(F.sum("n").alias("n"))


def gathered(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their counts, by part, on the driver: distinct n-grams of few bytes, which saturate as a corpus grows."""
    table = counts.toArrow()
    part = table["part"].combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    key, n = table["key"].to_numpy(), table["n"].to_numpy()
    del table
    index = np.asarray(part.indices)
    out = {}
    for i, name in enumerate(part.dictionary.to_pylist()):
        k, c = key[index == i], n[index == i]
        o = np.argsort(k)
        out[name] = k[o], c[o]
    return out


def score_rows(docs: DataFrame, n: int, shared, cost: Callable, to: str, text: str = "text", by: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with `to` double: the mean of cost(model, part, keys) over a text's n-grams; null for a null text."""
    ship(docs.sparkSession)
    columns = keep or [c for c in docs.columns if c != to]
    fields = [docs.schema[c] for c in columns]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField(to, T.DoubleType())])
    part = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("")) if by else F.lit("")
    rows = docs.select(*[f"`{c}`" for c in columns], part.alias("__part"), F.col(f"`{text}`").alias("__text"))

    def run(batches):
        model = shared.value
        for batch in batches:
            for b in blocks(batch, "__text"):
                parts = b.column(len(columns)).to_pylist()
                value = np.zeros(b.num_rows)
                names = np.array(parts, object)
                for name in set(parts):
                    at = np.flatnonzero(names == name)
                    key, size = gram_keys(*raw(b.column(len(columns) + 1).take(pa.array(at))), n)
                    bits = cost(model, name, key)
                    value[at] = np.add.reduceat(bits, np.cumsum(size) - size) / size
                null = pc.is_null(b.column(len(columns) + 1))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pc.if_else(null, None, pa.array(value))], [*columns, to])

    return rows.mapInArrow(eased(run), schema)
