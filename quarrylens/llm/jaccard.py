"""Operator 8: n-gram Jaccard join with signature trees.

Each distinct text becomes the set of its word n-grams (hashed) and a signature: a bitmap of the set, its size and its least hashes, as many
as are needed for a pair of the threshold to share none with a chance of at most MISS: routes() of them, 23 at 0.6, and all that a set of
fewer n-grams has. Two sets meet in the groups of the least hashes that both have. Hashes that one text alone has are dropped before
signatures move. In a group the signatures are the leaves of a tree, in an order that puts like sets side by side; an inner node holds the OR
of its bitmaps and the range of its sizes. The tree is traversed against itself: a pair of nodes whose greatest possible overlap is too
small for the threshold is cut with all below it. The bound never cuts a true pair. A pair that remains is reported by one group only, that
of the least hash both have, and is verified there on the whole n-gram sets. A group of more than HOT signatures is split into blocks by a
hash, and each pair of blocks is a task's work: no group is gathered in one place, and no pair is left out.

jaccard_classes() gives one row a document, its class and its links; copies are counted, never expanded into pairs.

Defined results: words are runs free of white space, in lower case; a text of fewer than n words has one n-gram of all it has; null,
empty and blank texts and rows without an id link with nothing. Rows of equal id and text count once. A document of several texts has the
links of all of them, those between its own texts included, and the least of their classes. Extra columns are ignored, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.components import components
from quarrylens.llm.textblock import MULT, blocks, col, eased, free, gram_hash, put_lists, raw, span_hash, word_spans
from quarrylens.runtime import discard, materialize, ship, small_side

N = 3
THRESHOLD = 0.6
MISS = 1e-9  # chance that a pair of the threshold meets nowhere
PARTS = 4  # of the groups, by their hash, that are routed one after another, so that a fraction of the routed signatures is on disk at a time
HOT = 4096  # signatures of the largest group that one task compares
LEAF, FAN = 16, 8
WORD = r"[^ \t\n\x0b\f\r\x1c-\x1f]"  # of text that has a word
WIDTHS = (512, 2048, 8192)  # bits of a signature, for sets of up to half as many n-grams


def routes(threshold: float, miss: float = MISS) -> int:
    """Least hashes a set is sent to: of two sets of Jaccard t, the least hashes of either hold none of the other's with a chance of at
    most (1 - t)**routes."""
    return 1 if threshold >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - threshold)))


def gram_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, offs = raw(pc.utf8_lower(col))
    starts, ends, doc = word_spans(data, offs)
    h, at = gram_hash(span_hash(data, starts, ends), doc, n)
    cut = np.searchsorted(doc[at], np.arange(len(col) + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield np.unique(h[a:b])


def signature(grams: np.ndarray) -> bytes:
    width = next((w for w in WIDTHS if len(grams) * 2 <= w), WIDTHS[-1])
    bits = np.zeros(width, np.uint8)
    with np.errstate(over="ignore"):
        bits[(grams * MULT >> np.uint64(48)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: bytes, width: int) -> np.ndarray:
    words = np.frombuffer(bits, np.uint64)
    return np.bitwise_or.reduce(words.reshape(-1, width // 64), 0)


def _signatures(n: int, routes: int):
    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                keep, size, bottom, bits = [], [], [], []
                for i, g in enumerate(gram_sets(b.column(1), n)):
                    if len(g):
                        keep.append(i)
                        size.append(len(g))
                        bottom.append(g[:routes])
                        bits.append(signature(g))
                least = np.concatenate(bottom).view(np.int64) if bottom else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(size, pa.int32()), put_lists(least, np.array([len(x) for x in bottom], np.int64), pa.int64()), pa.array(bits, pa.binary())], ["k", "size", "bottom", "bits"])

    return run


def groups(batches, key: str, most: int = 20000) -> Iterator[pa.Table]:
    """Tables holding whole groups of rows that are sorted by key, several small groups together."""
    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key))
        if held and rows >= most:
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1]
            other = np.flatnonzero(np.asarray(pc.not_equal(k, last)))
            if len(other):
                yield pa.Table.from_batches([*held, b.slice(0, other[0])]).combine_chunks()
                held, rows, b = [], 0, b.slice(other[0])
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Sets:
    """Signatures of sets: sizes, bitmaps in every width they have, and how many of a set's n-grams share a bit."""

    def __init__(self, size: np.ndarray, bits: list[bytes]):
        self.size = size
        self.kind = np.array([WIDTHS.index(len(x) * 8) for x in bits])
        self.bits = np.stack([fold(x, WIDTHS[0]) for x in bits])
        self.shared = size - np.bitwise_count(self.bits).sum(1)
        self.fine: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for kind in range(1, len(WIDTHS)):
            of = np.flatnonzero(self.kind >= kind)
            if len(of) > 1:
                place = np.full(len(size), -1)
                place[of] = np.arange(len(of))
                wide = np.stack([fold(bits[i], WIDTHS[kind]) for i in of])
                self.fine[kind] = place, wide, size[of] - np.bitwise_count(wide).sum(1)

    def possible(self, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Of pairs, those whose greatest possible overlap reaches the threshold."""
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        ok = small >= t * large - 1e-9
        a, b = a[ok], b[ok]
        need = t / (1 + t) * (self.size[a] + self.size[b]) - 1e-6
        most = np.bitwise_count(self.bits[a] & self.bits[b]).sum(1) + np.minimum(self.shared[a], self.shared[b])
        good = most >= need
        a, b, need = a[good], b[good], need[good]
        for kind, (place, wide, shared) in self.fine.items():
            w = np.flatnonzero((self.kind[a] >= kind) & (self.kind[b] >= kind))
            if len(w):
                x, y = place[a[w]], place[b[w]]
                cut = np.zeros(len(a), bool)
                for c in range(0, len(w), 4096):
                    s = slice(c, c + 4096)
                    cut[w[s]] = np.bitwise_count(wide[x[s]] & wide[y[s]]).sum(1) + np.minimum(shared[x[s]], shared[y[s]]) < need[w[s]]
                a, b, need = a[~cut], b[~cut], need[~cut]
        return np.stack([a, b])


@lru_cache(64)
def triangle(n: int) -> np.ndarray:
    return np.stack(np.triu_indices(n, 1))


def tree_pairs(s: Sets, members: np.ndarray, order: np.ndarray, t: float) -> np.ndarray:
    """Pairs of members left by the dual traversal of their signature tree; order: sort keys that put like sets side by side."""
    leaf = members[np.argsort(order, kind="stable")]
    levels = []
    cut = np.arange(0, len(leaf), LEAF)
    node = [np.bitwise_or.reduceat(s.bits[leaf], cut), np.minimum.reduceat(s.size[leaf], cut), np.maximum.reduceat(s.size[leaf], cut), np.maximum.reduceat(s.shared[leaf], cut)]
    levels.append(node)
    while len(node[0]) > 1:
        cut = np.arange(0, len(node[0]), FAN)
        node = [np.bitwise_or.reduceat(node[0], cut), np.minimum.reduceat(node[1], cut), np.maximum.reduceat(node[2], cut), np.maximum.reduceat(node[3], cut)]
        levels.append(node)

    def spread(a, b, fan, count):
        """Pairs of the children of node pairs, each unordered pair once."""
        i, j = np.divmod(np.arange(fan * fan), fan)
        x, y = (a[:, None] * fan + i).ravel(), (b[:, None] * fan + j).ravel()
        ok = (x <= y) & (x < count) & (y < count)
        return x[ok], y[ok]

    found = []
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > 2048:
            stack += [(depth, a[c : c + 2048], b[c : c + 2048]) for c in range(0, len(a), 2048)]
            continue
        bits, least, largest, shared = levels[depth]
        most = np.minimum(np.bitwise_count(bits[a] & bits[b]).sum(1) + np.minimum(shared[a], shared[b]), np.minimum(largest[a], largest[b]))
        ok = (largest[a] >= t * least[b] - 1e-9) & (largest[b] >= t * least[a] - 1e-9) & (most >= t / (1 + t) * (least[a] + least[b]) - 1e-6)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if depth:
            stack.append((depth - 1, *spread(a, b, FAN, len(levels[depth - 1][0]))))
        else:
            for c in range(0, len(a), 256):
                x, y = spread(a[c : c + 256], b[c : c + 256], LEAF, len(leaf))
                found.append(s.possible(leaf[x[x < y]], leaf[y[x < y]], t))
    return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)


def _traverse(t: float, width: int):
    """Rows (g, k, partners) for every set with a candidate pair in group g: the keys it is to be compared with. The rows of a cell are those
    of two blocks of a group, and pairs across them count, or those of one."""

    def run(batches):
        for table in groups(batches, "cell"):
            g, cell, block, across = (np.asarray(table[c]) for c in ("g", "cell", "block", "across"))
            keys = table["k"].to_pylist()
            s = Sets(np.asarray(table["size"]).astype(np.int64), table["bits"].to_pylist())
            bottom = np.full((len(g), width), np.iinfo(np.int64).max)  # of the least hashes, those that others have
            lists = table["bottom"].combine_chunks()
            n = np.asarray(pc.list_value_length(lists))
            rows = np.repeat(np.arange(len(g)), n)
            first = np.repeat(np.cumsum(n) - n, n)
            bottom[rows, np.arange(len(rows)) - first] = np.asarray(lists.flatten())
            cut = np.concatenate([[0], np.flatnonzero((np.diff(g) != 0) | (np.diff(cell) != 0)) + 1, [len(g)]])
            small, found = [], []
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if z - a > 2 * LEAF:
                    found.append(tree_pairs(s, np.arange(a, z), np.lexsort((s.size[a:z], bottom[a:z, min(1, width - 1)], bottom[a:z, 0])).argsort(), t))
                elif z - a > 1:
                    small.append(triangle(z - a) + a)
            if small:
                pairs = np.concatenate(small, 1)
                found += [s.possible(*pairs[:, c : c + 65536], t) for c in range(0, pairs.shape[1], 65536)]
            if not found:
                continue
            a, b = np.concatenate(found, 1)
            asked = ~across[a] | (block[a] != block[b])
            a, b = a[asked], b[asked]
            own = [np.zeros(0, bool)]
            for c in range(0, len(a), 32768):
                x, y = a[c : c + 32768], b[c : c + 32768]
                common = np.full(len(x), np.iinfo(np.int64).max)
                left = np.arange(len(x))
                for i in range(width):  # ascending: the first that both have is the least
                    left = left[i < n[x[left]]]
                    if not len(left):
                        break
                    has = (bottom[y[left]] == bottom[x[left], i][:, None]).any(1)
                    common[left[has]] = bottom[x[left[has]], i]
                    left = left[~has]
                own.append(common == g[x])
            own = np.concatenate(own)
            a, b = a[own], b[own]
            partners: dict[int, list[bytes]] = {}
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                partners.setdefault(x, []).append(keys[y])
                partners.setdefault(y, [])
            if partners:
                at = list(partners)
                yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array([keys[i] for i in at], pa.binary()), pa.array([partners[i] for i in at], pa.list_(pa.binary()))], ["cell", "k", "partners"])

    return run


def _grams(n: int):
    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                sets = list(gram_sets(b.column(1), n))
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), put_lists(flat, np.array([len(x) for x in sets], np.int64), pa.int64())], ["k", "grams"])

    return run


def _verify(t: float):
    def run(batches):
        for table in groups(batches, "cell", 2000):
            g = np.asarray(table["cell"])
            keys, partners = table["k"].to_pylist(), table["partners"].to_pylist()
            lists = table["grams"].combine_chunks()
            flat, offs = np.asarray(lists.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
            out: list[tuple[bytes, bytes, int, int]] = []
            cut = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                at = {keys[i]: i for i in range(a, z)}
                ids = np.unique(flat[offs[a] : offs[z]], return_inverse=True)[1]
                marks = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
                for i in range(a, z):
                    if partners[i]:
                        mine = ids[offs[i] - offs[a] : offs[i + 1] - offs[a]]
                        marks[mine] = True
                        for k in partners[i]:
                            j = at[k]
                            theirs = ids[offs[j] - offs[a] : offs[j + 1] - offs[a]]
                            both = int(np.count_nonzero(marks[theirs]))
                            if both >= t * (len(mine) + len(theirs) - both):
                                out.append((keys[i], k, both, len(mine) + len(theirs) - both))
                        marks[mine] = False
            ka, kb, both, either = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ka, pa.binary()), pa.array(kb, pa.binary()), pa.array(both, pa.int32()), pa.array(either, pa.int32())], ["ka", "kb", "both", "either"])

    return run


def text_key(text) -> F.Column:
    return F.unhex(F.md5(text))


def text_pairs(docs: DataFrame, text: str = "text", n: int = N, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(ka, kb, jaccard): pairs of distinct texts, by text_key(), whose n-gram sets are at least that alike."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    ship(spark)
    width = routes(threshold)
    texts = docs.where(col(text).isNotNull()).select(text_key(col(text)).alias("k"), col(text).alias("text"))
    signed = materialize(texts.mapInArrow(eased(_signatures(n, width)), "k binary, size int, bottom array<bigint>, bits binary").dropDuplicates(["k"]))
    posted = signed.select(F.explode("bottom").alias("g"), "k").withColumn("n", F.count("*").over(Window.partitionBy("g"))).where("n > 1")
    met = materialize(posted.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("g", F.ceil(F.col("n") / hot).cast("int").alias("blocks")))).alias("met")))  # at most width of them
    joined = materialize(signed.select("k", "size", "bits").join(met, "k"))
    discard(signed)
    discard(met)
    found = []
    for part in range(PARTS):
        routed = joined.select("k", "size", "bits", F.col("met.g").alias("bottom"), F.explode("met").alias("m")).select("k", "size", "bits", "bottom", "m.*").where(F.pmod(F.xxhash64("g"), F.lit(PARTS)) == part)
        routed = routed.withColumn("block", F.pmod(F.xxhash64("k"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        least, most = F.least("block", "other"), F.greatest("block", "other")
        routed = routed.select("g", F.xxhash64("g", least, most).alias("cell"), "k", "size", "bits", "bottom", "block", (least != most).alias("across")).repartition("cell").sortWithinPartitions("cell", "g")
        found.append(materialize(routed.mapInArrow(eased(_traverse(threshold, width)), "cell bigint, k binary, partners array<binary>")))
    discard(joined)
    parts, found = found, reduce(DataFrame.union, found)
    wanted = found.select("k").distinct()
    if small_side(found):
        wanted = F.broadcast(wanted)
    grams = texts.join(wanted, "k", "left_semi").mapInArrow(eased(_grams(n)), "k binary, grams array<bigint>").dropDuplicates(["k"])
    together = found.join(grams, "k").repartition("cell").sortWithinPartitions("cell").select("cell", "k", "partners", "grams")
    pairs = together.mapInArrow(eased(_verify(threshold)), "ka binary, kb binary, both int, either int")
    pairs = materialize(pairs.select("ka", "kb", (F.col("both").cast("double") / F.col("either").cast("double")).alias("jaccard")))
    for used in parts:
        discard(used)
    return pairs


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): of each document, the least id of its class (the documents that links join, step by step) and how many
    others' texts are at least that alike to its own. A document without links is a class of its own."""
    ids = docs.where(col(doc_id).isNotNull()).select(col(doc_id).alias("d"), F.when(col(text).rlike(WORD), text_key(col(text))).alias("k"))
    named = ids.where("k is not null").groupBy("k", "d").agg(F.lit(1).alias("one"))
    held = named.groupBy("k").agg(F.count("*").alias("copies"), F.min("d").alias("first"))
    pairs = text_pairs(docs.where(col(doc_id).isNotNull()), text, n, threshold).select("ka", "kb")
    linked = pairs.union(pairs.select("kb", "ka")).join(held.select(F.col("k").alias("kb"), "copies"), "kb")
    linked = linked.groupBy(F.col("ka").alias("k")).agg(F.sum("copies").alias("to"))
    nodes = components(pairs, "ka", "kb").select(F.col("node").alias("k"), "component")
    texts = held.join(linked, "k", "left").join(nodes, "k", "left").withColumn("c", F.coalesce("component", "k"))
    least = texts.groupBy("c").agg(F.min("first").alias("class"))
    texts = materialize(texts.join(least, "c").where("copies > 1 or to is not null").select("k", "class", (F.coalesce("to", F.lit(0)) + F.col("copies") - 1).alias("n")))
    side = F.broadcast(texts) if small_side(texts) else texts
    rows = ids.distinct().join(side, "k", "left").select("d", F.coalesce("class", "d").alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy(F.col("d").alias("doc_id")).agg(F.min("class").alias("class_id"), F.sum("n").alias("links"))


def near_duplicate_groups(docs: DataFrame, text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(k, component): of each text that is like another one, by text_key(), the least key of its group."""
    pairs = text_pairs(docs, text, n, threshold)
    out = components(pairs, "ka", "kb")
    discard(pairs)
    return out.select(F.col("node").alias("k"), "component")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of like texts: the one of the least id, and of those the least text key. Documents without
    text stay, all of them; a row of no id stays only where its group has none with one; of rows of equal id and text one stays. All columns
    pass through, whatever their names."""
    key, bk, bd, count = free(docs, "__k", "__bk", "__bd", "__n")
    keyed = docs.withColumn(key, F.when(col(text).rlike(WORD), text_key(col(text))))
    groups_of = near_duplicate_groups(docs, text, n, threshold).select("k", F.col("component").alias("g"))
    rows = keyed.where(col(key).isNotNull()).groupBy(col(key).alias("k"), col(doc_id).alias("d")).agg(F.count("*").alias("n"))
    rows = rows.join(groups_of, "k", "left").select("k", "d", "n", F.coalesce("g", "k").alias("g"))
    best = rows.groupBy("g").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "k", "n")).alias("b"))
    best = materialize(best.select("b.k", "b.d", "b.n"))
    side = best.select(F.col("k").alias(bk), F.col("d").alias(bd), F.col("n").alias(count))
    if small_side(best):
        side = F.broadcast(side)
    kept = keyed.join(side, col(key).eqNullSafe(col(bk)) & col(doc_id).eqNullSafe(col(bd)))
    once = kept.where(col(count) == 1).union(kept.where(col(count) > 1).dropDuplicates([key, doc_id])) if not best.where("n > 1").isEmpty() else kept
    columns = [col(c) for c in docs.columns]
    return once.select(*columns).union(keyed.where(col(key).isNull()).select(*columns))
