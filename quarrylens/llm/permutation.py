"""Operator 7: approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, the first PREFIX of them. Every row is indexed: it lies in one cell, that of the
nearest of a few first pivots, and in that cell is posted in the inverted file of each pivot of its prefix. A query goes to its nearest cells.
There it adds up, pivot by pivot, what the files say about the footrule distance of the two orders (a pivot beyond the prefix counts as at
its end), and the rows within a footrule radius, and no others, are reranked by exact cosine. How many cells a query visits and the radius
are learned: SAMPLE queries that are no pivots are answered by brute force, and both take in what they need for the recall wanted.
A cell of more than CELL rows is salted into parts of about CELL, each with files of its own, so that a task's index is bounded whatever
part of the table lies in one cell; queries pass by it in blocks. Where vectors have structure, few cells and a small radius do; where they
have none (independent directions), a query must visit much of the table, as with any index of that recall.

Bounds: the pivots (at most PIVOTS), the cells' pivots (as the root of the table) and the sample are fitted on a part chosen by hash; they
alone are collected and broadcast.

Defined results: null vectors, zero vectors, and vectors with a null, NaN or infinite entry or of another length than most (of lengths
equally common the least) are neither queries nor answers. Rows of equal id count once (the least vector). Ties go to the smaller id; ties in
footrule distance are all reranked. Extra columns are ignored, whatever their names. A table of one vector or none has no neighbours; a query
may have fewer than k.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.textblock import eased
from quarrylens.runtime import discard, materialize, ship

K = 10
PIVOTS, PREFIX = 512, 64
CELL = 16384  # rows of a part, about
SAMPLE = 256  # queries answered by brute force to learn cells and radius
IN_CELLS, IN_RADIUS = 0.985, 0.965  # shares of the sample's true neighbours


def shape(n: int) -> tuple[int, int, int]:
    """Pivots, prefix length and cells for n vectors."""
    pivots = max(1, min(PIVOTS, n // 4))
    return pivots, min(pivots, PREFIX, max(1, pivots // 4)), max(1, round(math.sqrt(n) / 64))


def vectors(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.float32)


def prefixes(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each vector, nearest first; of equal ones the smaller number."""
    return np.argsort(-(x @ pivots.T), 1, kind="stable")[:, :m].astype(np.int32)


def places(order: np.ndarray, pivots: int) -> np.ndarray:
    """(vectors, pivots): m at the nearest pivot, 1 at the last of the prefix, 0 beyond. The footrule distance of two rows is
    m (m + 1) less twice the sum of their minima."""
    m = order.shape[1]
    out = np.zeros((len(order), pivots), np.uint16)
    np.put_along_axis(out, order.astype(np.int64), np.broadcast_to(np.arange(m, 0, -1, dtype=np.uint16), order.shape), 1)
    return out


class Files:
    """The inverted files of a part: of each pivot, the rows that have it in their prefix and the place it has there."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.m = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = (by // self.m).astype(np.int32)
        self.place = (self.m - by % self.m).astype(np.uint16)
        self.cut = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.sums = np.zeros(n, np.uint16 if self.m < 300 else np.uint32)

    def within(self, prefix: np.ndarray, least: int) -> np.ndarray:
        """Rows whose order is within the radius: the minima of their places and the query's add up to `least`."""
        sums = self.sums
        sums[:] = 0
        for j, p in enumerate(prefix.tolist()):
            a, z = self.cut[p], self.cut[p + 1]
            sums[self.rows[a:z]] += np.minimum(self.place[a:z], self.m - j)
        return np.flatnonzero(sums >= least)


def best(ids: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, of equal ones the smaller id."""
    if len(sim) > 4 * k:
        edge = -np.partition(-sim, k - 1)[k - 1]
        some = np.flatnonzero(sim >= edge)
        return some[np.lexsort((ids[some], -sim[some]))[:k]]
    return np.lexsort((ids, -sim))[:k]


def clean(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): one unit vector an id, all of one length."""
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0").where(finite)
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).where("n > 0")
    rows = materialize(rows.select("id", F.transform("v", lambda e: (e / F.col("n")).cast("float")).alias("v")))
    length = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return rows.where(F.size("v") == (length["s"] if length else 0))


def _chosen(rows: DataFrame, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of n rows by a seeded hash."""
    got = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).toArrow()
    return np.asarray(got["id"]), vectors(got["v"].combine_chunks())


def nearest(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, queries: Column | None = None, in_cells: float = IN_CELLS, in_radius: float = IN_RADIUS, cell: int = CELL) -> DataFrame:
    """(vec_id, neighbour, rank, similarity): the k nearest vectors, among all, of each that the condition `queries` on column id picks (of
    every one without it), by cosine."""
    spark = table.sparkSession
    ship(spark)
    rows = clean(table, vec_id, embedding)
    n = rows.count()
    out = "vec_id bigint, neighbour bigint, rank int, similarity double"
    if n < 2:
        return spark.createDataFrame([], out)
    count, m, cells = shape(n)
    pivot_ids, pivots = _chosen(rows, 3, max(count, cells))
    sample_ids, sample = _chosen(rows.where(~F.col("id").isin([int(i) for i in pivot_ids])), 5, SAMPLE)
    pivots, heads = pivots[:count], pivots[:cells]  # of the orders, of the cells

    def truth(batches):
        for b in batches:
            x, ids = vectors(b.column(1)), np.asarray(b.column(0))
            if not len(ids):
                continue
            sim = sample @ x.T
            sim[sample_ids[:, None] == ids[None]] = -np.inf
            t = np.argsort(-sim, 1, kind="stable")[:, :k]
            got = np.take_along_axis(sim, t, 1)
            rows_, cols = np.nonzero(np.isfinite(got))
            at = t[rows_, cols]
            yield pa.RecordBatch.from_arrays([pa.array(rows_.astype(np.int32)), pa.array(ids[at]), pa.array(got[rows_, cols]), b.column(1).take(pa.array(at))], ["q", "id", "sim", "v"])

    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    exact = rows.mapInArrow(eased(truth), "q int, id bigint, sim float, v array<float>").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toArrow()
    least, visits = 1, cells
    if exact.num_rows:
        q, found = np.asarray(exact["q"]), vectors(exact["v"].combine_chunks())
        mine = places(prefixes(sample, pivots, m), count)[q]
        least = max(1, int(np.quantile(np.minimum(mine, places(prefixes(found, pivots, m), count)).sum(1, dtype=np.int64), 1 - in_radius)))
        rank = np.argsort(prefixes(sample, heads, cells), 1)[q, prefixes(found, heads, 1)[:, 0]]
        visits = int(np.quantile(rank, in_cells, method="higher")) + 1

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = vectors(b.column(1))
                order, near = prefixes(x, pivots, m), prefixes(x, heads, visits)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, o.size + 1, o.shape[1], dtype=np.int32)), pa.array(o.ravel())) for o in (order, near)]
                yield pa.RecordBatch.from_arrays([*b.columns, *lists], ["id", "v", "prefix", "cells"])

    placed = materialize(rows.mapInArrow(eased(place), "id bigint, v array<float>, prefix array<int>, cells array<int>"))
    discard(rows)
    sizes = {r[0]: r[1] for r in placed.groupBy(F.col("cells")[0]).count().collect()}  # as many rows as there are cells
    parts = F.create_map(*[F.lit(int(x)) for c in range(cells) for x in (c, max(1, -(-sizes.get(c, 0) // cell)))])
    salt = F.pmod(F.xxhash64("id", F.lit(7)), parts[F.col("cell")]).cast("int")
    objects = placed.withColumn("cell", F.col("cells")[0]).select("cell", salt.alias("salt"), F.lit(False).alias("asks"), "id", "v", "prefix")
    asked = placed if queries is None else placed.where(queries)
    asked = asked.select(F.explode("cells").alias("cell"), "id", "v", "prefix").withColumn("salt", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)))
    both = objects.unionByName(asked.withColumn("asks", F.lit(True)).select(objects.columns)).withColumn("part", F.col("cell") * (1 << 20) + F.col("salt"))
    both = both.select("part", "asks", "id", "v", "prefix").repartition("part").sortWithinPartitions("part", "asks")

    def answer(batches):
        part, held, files, ids, x = None, [], None, None, None
        for b in batches:
            keys, asks = np.asarray(b.column(0)), np.asarray(b.column(1).cast(pa.int8()), bool)
            cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1, [len(keys)]]).tolist() if len(keys) else [0]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                s = b.slice(a, z - a)
                if keys[a] != part:
                    part, held, files = keys[a], [], None
                if not asks[a]:
                    held.append(s)
                    continue
                if not held:  # a cell that holds nothing
                    continue
                if files is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    ids, x = np.asarray(t["id"]), vectors(t["v"].combine_chunks())
                    files = Files(np.asarray(t["prefix"].combine_chunks().flatten()).reshape(-1, m), count)
                names, v, order = np.asarray(s.column(2)), vectors(s.column(3)), np.asarray(s.column(4).flatten()).reshape(-1, m)
                q, other, sims = [], [], []
                for i in range(len(names)):
                    near = files.within(order[i], least)
                    near = near[ids[near] != names[i]]
                    sim = x[near] @ v[i]
                    top = best(ids[near], sim, k)
                    q.append(np.full(len(top), names[i]))
                    other.append(ids[near[top]])
                    sims.append(sim[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (q, other, sims)], ["vec_id", "neighbour", "similarity"])

    found = both.mapInArrow(eased(answer), "vec_id bigint, neighbour bigint, similarity float")
    w = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "neighbour", "rank", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))
