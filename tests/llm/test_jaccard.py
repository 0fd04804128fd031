import hashlib
import itertools
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from quarrylens.llm import jaccard as J
from quarrylens.llm.components import components
from quarrylens.runtime import shared_dir


def grams(text, n=3):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, t):
    """Pairs of distinct texts."""
    texts = sorted({r[1] for r in rows if r[0] is not None and r[1] and r[1].split()})
    sets = {x: grams(x) for x in texts}
    out = {}
    for x, y in itertools.combinations(texts, 2):
        g, h = sets[x], sets[y]
        if min(len(g), len(h)) >= t * max(len(g), len(h)) and len(g & h) >= t * len(g | h):
            out[x, y] = len(g & h) / len(g | h)
    return out


def classes(rows, t):
    ids = {}
    for d, x in set(rows):
        if d is not None:
            ids.setdefault(x if x and x.split() else None, set()).add(d)
    root = {x: x for x in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    links = {x: len(d) - 1 if x is not None else 0 for x, d in ids.items()}
    for x, y in brute(rows, t):
        links[x] += len(ids[y])
        links[y] += len(ids[x])
        root[find(x)] = find(y)
    least = {}
    for x, d in ids.items():
        least[find(x)] = min([least.get(find(x), min(d)), *d])
    out = {}
    for x, some in ids.items():
        for d in some:
            c, n = (least[find(x)], links[x]) if x is not None else (d, 0)
            old = out.get(d, (c, 0))
            out[d] = (min(old[0], c), old[1] + n)
    return out


def key(text):
    return hashlib.md5(text.encode()).digest()


def got_classes(df):
    rows = [tuple(r) for r in J.jaccard_classes(df).select("doc_id", "class_id", "links").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def variants(rng, n, length):
    words = [f"w{rng.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(length // 12 + 1)):
            w[rng.randrange(length)] = f"z{rng.randrange(9)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [t for k in range(4) for t in variants(rng, 50, 30 + 20 * k)] + [" ".join(f"u{rng.randrange(900)}" for _ in range(40)) for _ in range(60)]
    texts += variants(rng, 4, 1500) + variants(rng, 3, 9000)
    texts += rng.sample(texts, 40)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows, J.THRESHOLD)
    assert got_classes(df) == want and sum(n for _, n in want.values()) > 2000


def test_no_pair_is_left_out_at_any_threshold_and_in_split_groups(spark):
    rng = random.Random(6)
    texts = [t for k in range(3) for t in variants(rng, 70, 20 + 30 * k)] + ["common words of one and all " + " ".join(f"u{rng.randrange(99)}" for _ in range(9)) for _ in range(80)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for t, hot in ((0.3, 4096), (0.5, 20), (0.8, 4096)):
        want = {frozenset(map(key, p)): v for p, v in brute(rows, t).items()}
        got = [(frozenset((bytes(r[0]), bytes(r[1]))), r[2]) for r in J.text_pairs(df, threshold=t, hot=hot).collect()]
        assert len(got) == len(want) and {p: round(v, 9) for p, v in got} == {p: round(v, 9) for p, v in want.items()}


def test_routes_follow_the_threshold():
    assert [J.routes(t) for t in (0.3, 0.6, 0.8, 1.0)] == [59, 23, 13, 1]


def test_tree_cuts_no_true_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.15 * (k % 4), rng.integers(0, 2**63, 60).astype(np.uint64), base)) for k in range(150)]
    s = J.Sets(np.array([len(x) for x in sets]), [J.signature(x) for x in sets])
    got = {tuple(sorted(p)) for p in J.tree_pairs(s, np.arange(150), np.array([int(x[0] % np.uint64(1000)) for x in sets]), 0.6).T.tolist()}
    want = {(a, b) for a, b in itertools.combinations(range(150), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))}
    assert want <= got and len(got) < 150 * 149 / 2


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    odd = odd.withColumns({c: F.lit("same") for c in ("__n", "__k", "__bk", "a.b", "n", "class", "class_id", "copies", "cell")})
    assert got_classes(odd) == classes(rows, J.THRESHOLD)
    assert J.jaccard_classes(none).count() == 0
    kept = J.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and J.drop_near_duplicates(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in set(rows))


def test_one_of_each_group_stays(spark):
    rng = random.Random(1)
    rows = list(enumerate(variants(rng, 20, 60))) + [(100, "alone in the world with words of its own"), (None, variants(random.Random(1), 1, 60)[0]), (5, None)]
    kept = J.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "100", "5"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(7, None), (9, 9)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_are_whole():
    rows = [k for k in range(50) for _ in range(k % 7 + 1)]
    batches = [pa.RecordBatch.from_pydict({"g": rows[i : i + 9]}) for i in range(0, len(rows), 9)]
    seen = [t["g"].to_pylist() for t in J.groups(batches, "g", 20)]
    assert sum(seen, []) == rows
    assert all(set(a).isdisjoint(b) for a, b in itertools.combinations(seen, 2))


def test_only_the_pairs_are_left_on_disk(spark):
    """Neither intermediate tables nor shuffle files of text_pairs() stay when it has its pairs."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    files = lambda: {x for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    tables, before = set(shared.glob("ql-*")), files()
    df = spark.createDataFrame(list(enumerate(variants(random.Random(4), 40, 60))), "doc_id long, text string")
    pairs = J.text_pairs(df)
    left = set(shared.glob("ql-*")) - tables
    assert [str(x) for x in left] == [pairs._ql_path.removeprefix("file://")]
    for _ in range(50):  # they are deleted in the background
        if not (more := files() - before):
            break
        time.sleep(0.2)
    assert not more and pairs.count()
