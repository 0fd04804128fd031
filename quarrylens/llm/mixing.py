"""Operator 6: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are put in a random order (a seeded hash) and cut into blocks of BLOCK documents, the last one shorter. The
mixture takes whole quotas: the most documents for which every source can give its target share, rounded so that they add up. The
blocks that hold a source's quota are then divided among the output shards by a binary tree: a node that has some blocks of each source
and leads to some of the shards sends its left half a number of blocks drawn from the multivariate hypergeometric distribution, so that
the tree as a whole draws what dealing all blocks from one shuffled deck would, and each shard gets as many blocks as its neighbours, to
within one. Leaves take disjoint ranges of each source's permuted blocks; the documents of a shard are shuffled locally.

A source's order is never sorted in one place: documents are counted by (source, slice of the hash), slices give the ranks where they
begin, and a window ranks inside a slice; the slices get as many as the source is large. All of this moves hashes only: each document is
sent once, to the places that its hash got.

Defined results: a null source is a source of its own, of the key None. A source without a weight has weight 0 and gives nothing; weights
of sources that are not there are left out. Without weights, each source that is there weighs the same. Rows of equal hash (repeated rows) are in an order that
depends on the partitions' order alone; each still has its own place. An empty table, or weights that are all zero, give no rows. Null
and empty texts are documents like any other. Columns named mix_shard, mix_block or mix_place are replaced; all others pass through, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.textblock import col, renamed
from quarrylens.runtime import materialize, small_side

BLOCK = 64  # documents a block
SLICE = 20000  # documents a slice of a source's order, about
EPOCHS = 4  # times that a scarce source is gone through at most, where all documents are to be taken


def _order(source: object) -> tuple:
    return (source is not None, 0 if source is None else source)


def quotas(counts: Mapping[str, int], weights: Mapping[str, float], epochs: int | None = None) -> dict[str, int]:
    """Documents to take of each source: in proportion to its weight, none more than it has, as many in all as that allows; what
    rounding down leaves over goes to the largest remainders. With epochs: in proportion to its weight, all that it has at least, as few in
    all as that allows, and up to `epochs` times what it has."""
    w = {s: float(weights.get(s, 0.0)) for s, n in counts.items() if n > 0}
    if any(not math.isfinite(x) or x < 0 for x in w.values()):
        raise ValueError("weights must be finite and not negative")
    w = {s: x for s, x in w.items() if x > 0}
    total = sum(w.values())
    if not total:
        return {}
    if epochs is not None:
        if epochs < 1:
            raise ValueError("epochs must be at least 1")
        scale = max(counts[s] / w[s] for s in w)
        return {s: max(counts[s], min(epochs * counts[s], math.floor(scale * x + 0.5))) for s, x in w.items()}
    most = min(counts[s] * total / w[s] for s in w)
    want = {s: most * w[s] / total for s in w}
    out = {s: min(counts[s], math.floor(x + 1e-9)) for s, x in want.items()}
    spare = math.floor(most + 1e-9) - sum(out.values())
    for s in sorted(w, key=lambda s: (out[s] - want[s], _order(s))):
        if spare > 0 and out[s] < counts[s]:
            out[s] += 1
            spare -= 1
    return out


def temperature_weights(docs: DataFrame, power: float = 0.5, source: str = "source", nulls: bool = False) -> dict[str | None, float]:
    """Target weights that flatten the sources' sizes: each source's documents to a power; with nulls, the null source's too."""
    return {r[0]: float(r[1]) ** power for r in docs.where(F.lit(nulls) | col(source).isNotNull()).groupBy(col(source)).agg(F.count("*")).collect()}


def split_tree(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many of each source's blocks each shard gets. Every row sums to the same number, to within one."""
    out = np.zeros((shards, len(blocks)), np.int64)
    stack = [(0, shards, np.asarray(blocks, np.int64), 1)]
    while stack:
        first, n, have, node = stack.pop()
        if n == 1:
            out[first] = have
            continue
        left = n // 2
        total = int(have.sum())
        rng = np.random.Generator(np.random.Philox(key=[seed, node]))
        share = total * left // n
        if total * left % n and rng.random() < total * left % n / n:
            share += 1
        drawn = rng.multivariate_hypergeometric(have, share, method="marginals") if total else np.zeros_like(have)
        stack += [(first, left, drawn, 2 * node), (first + left, n - left, have - drawn, 2 * node + 1)]
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", seed: int = 11, shards: int | None = None, block: int = BLOCK, epochs: int | None = None) -> DataFrame:
    """The documents of the mixture, with all their columns, and mix_shard int, mix_block long (of the source) and mix_place long: the place
    in the shard after its local shuffle, from 0. A document that is taken in several epochs has a row for each."""
    spark = docs.sparkSession
    added = ["mix_shard", "mix_block", "mix_place"]
    docs = docs.drop(*added)
    names_out = docs.columns
    doc_id, source = (f"c{names_out.index(c)}" for c in (doc_id, source))
    docs = renamed(docs)
    content = [c for c in docs.columns if c != doc_id and not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    order = F.xxhash64(F.lit(seed), doc_id, *content)
    keyed = docs.withColumn("__o", order)
    counts = {r[0]: r[1] for r in docs.groupBy(source).agg(F.count("*")).collect()}
    take = quotas(counts, weights if weights is not None else {s: 1.0 for s in counts}, epochs)
    take = {s: n for s, n in sorted(take.items(), key=lambda x: _order(x[0])) if n > 0}
    names = list(take)
    n_blocks = np.array([-(-take[s] // block) for s in names], np.int64)
    if shards is None:
        shards = max(1, round(math.sqrt(sum(take.values())) / 8))
    if not names:
        return docs.limit(0).withColumns({"mix_shard": F.lit(0), "mix_block": F.lit(0).cast("long"), "mix_place": F.lit(0).cast("long")}).toDF(*names_out, *added)
    deal = split_tree(n_blocks, shards, seed)
    to = np.cumsum(deal, 0)

    # what is moved: a row's hash, its number among rows of the same hash, and its source
    same = materialize(keyed.groupBy("__o").agg(F.count("*").alias("n")).where("n > 1").select("__o"))
    side = F.broadcast(same) if small_side(same) else same
    number = F.row_number().over(Window.partitionBy("__o").orderBy("__o"))
    whole = keyed.join(side, "__o", "left_anti").withColumn("__n", F.lit(1)).unionByName(keyed.join(side, "__o", "left_semi").withColumn("__n", number))
    slim = keyed.select("__o", F.col(source).alias("__src"))
    slim = slim.join(side, "__o", "left_anti").withColumn("__n", F.lit(1)).unionByName(slim.join(side, "__o", "left_semi").withColumn("__n", number))

    # slices of each source's order, and the rank where each begins
    n_slices = {s: max(1, round(counts[s] / SLICE)) for s in names}
    info = spark.createDataFrame([(s, j, take[s], counts[s], n_slices[s]) for j, s in enumerate(names)], T.StructType([T.StructField("__v", docs.schema[source].dataType), T.StructField("__s", T.IntegerType()), T.StructField("__take", T.LongType()), T.StructField("__have", T.LongType()), T.StructField("__slices", T.IntegerType())]))
    info = F.broadcast(info) if len(names) <= 100_000 else info
    unit = (F.shiftrightunsigned("__o", 33)).cast("double") / F.lit(float(2**31))
    keyed = slim.join(info, F.col("__src").eqNullSafe(F.col("__v"))).withColumn("__slice", F.floor(unit * F.col("__slices")).cast("int"))
    begins = keyed.groupBy("__s", "__slice").agg(F.count("*").alias("n"))
    begins = begins.withColumn("__begin", F.sum("n").over(Window.partitionBy("__s").orderBy("__slice")) - F.col("n")).drop("n")
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__slice").orderBy(F.shiftrightunsigned("__o", 33), "__o")))
    if sum(n_slices.values()) <= 200_000:
        begins = F.broadcast(begins)
    placed = ranked.join(begins, ["__s", "__slice"]).withColumn("__rank", F.col("__begin") + F.col("__r") - 1).where("__rank < __take")
    if epochs is not None:  # the places that a document has in the order gone through again and again
        placed = placed.withColumn("__rank", F.explode(F.sequence(F.col("__rank"), F.col("__take") - 1, F.col("__have"))))
    placed = placed.withColumn("mix_block", F.floor(F.col("__rank") / block).cast("long"))

    # the shards' ranges of each source's blocks
    starts = to - deal
    ranges = [(j, [int(x) for x in np.flatnonzero(deal[:, j])], [int(x) for x in starts[deal[:, j] > 0, j]]) for j in range(len(names))]
    ranges = spark.createDataFrame(ranges, T.StructType([T.StructField("__rs", T.IntegerType()), T.StructField("__shards", T.ArrayType(T.IntegerType())), T.StructField("__starts", T.ArrayType(T.LongType()))]))
    per_block = ranges.select("__rs", F.explode(F.arrays_zip("__shards", "__starts")).alias("z"), "__starts", F.size("__starts").alias("k"))
    limits = {j: int(b) for j, b in enumerate(n_blocks)}
    ends = F.create_map(*[x for j in limits for x in (F.lit(j), F.lit(limits[j]))]) if len(names) <= 1000 else None
    span = Window.partitionBy("__rs").orderBy("z.__starts")
    stop = F.lead("z.__starts").over(span)
    per_block = per_block.select("__rs", F.col("z.__shards").alias("mix_shard"), F.col("z.__starts").alias("a"), stop.alias("b"))
    if ends is not None:
        per_block = per_block.withColumn("b", F.coalesce("b", ends[F.col("__rs")]))
    else:
        last = spark.createDataFrame(list(limits.items()), T.StructType([T.StructField("__rs", T.IntegerType()), T.StructField("z", T.LongType())]))
        per_block = per_block.join(last, "__rs").withColumn("b", F.coalesce("b", "z")).drop("z")
    per_block = per_block.select("__rs", "mix_shard", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("__b"))
    if int(n_blocks.sum()) <= 200_000:
        per_block = F.broadcast(per_block)
    placed = placed.join(per_block, (F.col("__s") == F.col("__rs")) & (F.col("mix_block") == F.col("__b")))
    local = Window.partitionBy("mix_shard").orderBy(F.xxhash64("__o", F.lit(seed + 1), F.floor(F.col("__rank") / F.col("__have"))), "__o", "__s", "__rank")
    placed = placed.withColumn("mix_place", F.row_number().over(local).cast("long") - 1).select("__o", "__n", *added)
    return whole.join(placed, ["__o", "__n"]).select(*docs.columns, *added).toDF(*names_out, *added)
