import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quarrylens.llm import passages as P
from quarrylens.runtime import shared_dir


def sentence(rng, lo=4, hi=11):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(lo, hi))).capitalize() + "."


def prose(rng, n):
    return " ".join(sentence(rng) for _ in range(n))


def test_planted_passages_are_found_and_clean_text_stays(spark):
    rng = random.Random(4)
    passages = [prose(rng, 11) for _ in range(8)]
    rows, planted = [], {}
    for i in range(60):
        w = prose(rng, 12).split()
        if i % 2:
            at = rng.randrange(len(w))
            w[at:at] = passages[i % 8].split()
            planted.setdefault(passages[i % 8], []).append(i)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in P.substring_repeats(docs).collect():
        found.setdefault(r["doc_id"], []).append(rows[r["doc_id"]][1][r["start"] : r["end"]])
    assert all(i % 2 for i in found)
    for p, ids in planted.items():
        assert ids[0] not in found
        for i in ids[1:]:
            got = sum(len(x.split()) for x in found[i])
            assert got >= len(p.split()) - 12 and all(x in p for x in found[i])
    left = {r["doc_id"]: r["text"] for r in P.dedup(docs).collect()}
    assert len(left) == 60 and all(left[i] == t for i, t in rows if i % 2 == 0)


def test_near_lines(spark):
    rng = random.Random(9)
    line = [f"v{rng.randrange(999)}" for _ in range(80)]
    rows = []
    for i in range(30):
        w = list(line)
        w[rng.randrange(80)] = f"changed{i}"
        rows.append((i, prose(rng, 6) + "\n" + " ".join(w)))
    out = P.substring_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == set(range(1, 30)) and all(0 in r["kept_in"] for r in out)


def test_every_run_and_line_against_brute_force(spark):
    rng = random.Random(2)
    lines = [prose(rng, rng.randrange(1, 6)) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(3))) for i in range(25)]
    found = {}
    for r in P.substring_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    seen = set()
    for i, t in rows:
        at = 0
        for line in t.split("\n"):
            if len(line.split()) >= P.WORDS:
                if line in seen:
                    assert set(range(at, at + len(line))) <= found[i]
                seen.add(line)
            at += len(line) + 1


def test_odd_rows(odd, none):
    odd = odd.withColumns({c: F.lit("same") for c in ("__t", "__d", "__m", "__spans", "a.b", "e", "s", "h", "h2", "kd", "bands")})
    none = odd.limit(0)
    out = P.substring_repeats(odd).collect()
    assert all(r["doc_id"] == 5 and r["kept_in"] == [5] for r in out)  # the long text repeats itself
    kept = P.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert kept.where("doc_id <> 5").exceptAll(odd).count() == 0
    assert kept.where("n_chars is distinct from length(text) and doc_id = 5").count() == 0
    assert P.substring_repeats(none).count() == 0 and P.dedup(none).count() == 0


def test_a_document_of_nothing_but_a_repeat_goes(spark):
    text = prose(random.Random(1), 9)
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (3, "  "), (4, None)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in P.dedup(docs).select(F.col("doc_id")).collect()) == ["1", "3", "4"]


def test_repeats_of_fifty_words_are_found_whole_wherever_they_lie(spark):
    """Passages cut from the middle of sentences, or without any, set into other lines."""
    rng = random.Random(12)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passages = [own(50), own(60), " ".join(prose(rng, 14)[5:].split()[1:56]).split(), own(120)]
    rows, want = [], {}
    for i in range(16):
        p = passages[i % 4]
        before, after = own(7 + 5 * i), own(9 + 3 * i)
        rows.append((i, " ".join(before + p + after)))
        start = len(" ".join(before)) + 1
        want[i] = (start, start + len(" ".join(p)))
    # of passages[3] and what follows it, 12 words more are the same in two documents only
    tail = own(12)
    for i in (20, 21):
        before = own(48)
        rows.append((i, " ".join(before + passages[3] + tail + own(49))))
        start = len(" ".join(before)) + 1
        want[i] = (start, start + len(" ".join(passages[3] + (tail if i == 21 else []))))
    got = {r["doc_id"]: (r["start"], r["end"]) for r in P.substring_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: x for i, x in want.items() if i > 3}


def test_short_lines_wrapped_paragraphs_and_text_without_spaces(spark):
    rng = random.Random(31)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    sign = lambda n, lo, hi: "".join(chr(rng.randrange(lo, hi)) for _ in range(n))
    line = own(9)
    wrapped = [own(7) for _ in range(8)]
    near = list(wrapped)
    near[3] = " ".join(["changed", *near[3].split()[1:]])
    wide = [sign(60, 0x4E00, 0x9000), sign(60, 0xE01, 0xE2F)]
    stops = "".join(f"{sign(11, 0x4E00, 0x9000)}。" for _ in range(3))
    texts = [
        f"{own(30)}\n{line}\n{own(30)}", f"{own(25)}\n{line}\n{own(40)}",
        own(30) + "\n\n" + "\n".join(wrapped) + "\n\n" + own(33), own(31) + "\n\n" + "\n".join(near) + "\n\n" + own(32),
        *(sign(40, lo, hi) + w + sign(40, lo, hi) for w, lo, hi in ((wide[0], 0x4E00, 0x9000), (wide[0], 0x4E00, 0x9000), (wide[1], 0xE01, 0xE2F), (wide[1], 0xE01, 0xE2F))),
        sign(15, 0x4E00, 0x9000) + "。" + stops + sign(15, 0x4E00, 0x9000), sign(25, 0x4E00, 0x9000) + "。" + stops + sign(35, 0x4E00, 0x9000),
    ]
    want = {1: line, 3: "\n".join(near), 5: wide[0], 7: wide[1], 9: stops}
    out = P.substring_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: texts[r["doc_id"]][r["start"] : r["end"]] for r in out}
    assert set(got) == set(want) and len(out) == len(want)
    assert all(want[k] in got[k] and len(got[k]) <= len(want[k]) + 2 for k in want)  # Thai has so few letters that a neighbour may be the same


def jaccard(a, b, n=3):
    grams = lambda x: {tuple(x.split()[i : i + n]) for i in range(max(1, len(x.split()) - n + 1))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def left(docs):
    return [r["text"] for r in P.dedup(docs).select("text").collect()]


def test_a_repeat_inside_a_near_line_stays_somewhere(spark):
    rng = random.Random(77)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    a, b, r, q = own(150), own(150), own(50), own(55)
    rows = [(1, f"{a} {b}"), (2, f"{a} {r} {b}"), (3, f"{own(60)} {r}"), (4, f"{a} {q} {b}"), (5, f"{b} {own(3)}"), (6, f"{a} {q} {b} {own(4)}")]
    texts = left(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(sum(x in t for t in texts) == 1 for x in (r, q))


@pytest.mark.parametrize("seed", range(2))
def test_no_repeat_is_lost_in_chains_of_near_lines_runs_and_null_ids(spark, seed):
    """Every word of every planted run is still there, beside a neighbour in its run; so is one text of each group of near lines."""
    rng = random.Random(seed)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    runs, bases = [own(rng.randrange(22, 70)) for _ in range(6)], [own(120) for _ in range(3)]
    rows = []
    for i in range(40):
        words = rng.choice(bases).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = own(1)
        for r in rng.sample(runs, rng.randrange(3)):
            at = rng.randrange(len(words))
            words[at:at] = r.split()
        text = " ".join(words) if rng.random() < 0.7 else f"{own(30)}\n{' '.join(words)}\n{rng.choice(runs)}"
        rows.append((None if rng.random() < 0.3 else rng.randrange(30), text))
    rows += [(99, f"{own(40)} {r} {own(40)}") for r in runs[:3]]
    found = set(" ".join(left(spark.createDataFrame(rows, "doc_id long, text string"))).split())
    before = " ".join(t for _, t in rows)
    for r in runs:
        if before.count(r) > 1:
            assert set(r.split()) <= found
    assert all(len(set(b.split()) & found) > 90 for b in bases if b.split()[0] in before)


def test_null_ids_are_told_apart(spark):
    r = " ".join(f"r{i}" for i in range(60))
    rows = [(0, r)] + [(None, f"{' '.join(f'x{i}y{j}' for j in range(40))} {r} tail{i}") for i in range(12)]
    texts = left(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r in t for t in texts) == 1 and len(texts) == 13


@pytest.mark.parametrize(("threshold", "hot"), [(0.3, 4000), (0.5, 10), (0.8, 4000)])
def test_near_lines_against_exact_jaccard(spark, threshold, hot):
    rng = random.Random(19)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(int(len(w) * (1 - threshold) / 6) + 2)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    rows = list(enumerate(texts))
    shape = P.shape(threshold)
    docs = spark.createDataFrame(rows, "d long, text string").select("d", P.text_mark(F.col("text")).alias("t"), "text")
    pieces = docs.mapInArrow(P._emit_lines(8, shape), "h bigint, d bigint, t bigint, s int, e int, bands array<int>").persist()
    place = {r["h"]: r["d"] for r in pieces.collect()}
    cluster = {}
    for r in P.near_lines(docs, pieces, threshold, 8, shape, hot)[0].collect():
        cluster.setdefault(r["cluster"], set()).add(place[r["line"]])
    got = {frozenset(x) for x in cluster.values()}
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, x in enumerate(texts):
        for j in range(i):
            if jaccard(x, texts[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    assert len(got & want) >= 0.9 * len(want) and all(any(x <= y for y in want) for x in got) and len(want) > 8


def test_settled_spans_against_marks():
    rng = random.Random(3)
    for _ in range(200):
        events = [sorted(rng.sample(range(40), 2)) for _ in range(rng.randrange(1, 9))]
        lo, hi = P.settle(*(np.array(c) for c in zip(*events, strict=True)))
        assert [any(a <= x < b for a, b in zip(lo, hi, strict=True)) for x in range(40)] == [any(s <= x < e for s, e in events) for x in range(40)]
        assert all(b < a for b, a in zip(hi, lo[1:], strict=False))


def test_a_crowded_band_takes_no_step_of_python_a_pair():
    """1500 lines of one band, each unlike the others."""
    rng = np.random.RandomState(6)
    grams = [rng.randint(0, 300, 60) for _ in range(1500)]
    batch = pa.record_batch({"line": pa.array(range(1500)), "c": pa.array([1] * 1500), "bands": pa.array([[1]] * 1500, pa.list_(pa.int32())), "grams": pa.array(grams, pa.list_(pa.int64()))})
    began = time.process_time()
    out = list(P._clusters(0.7, 1)(iter([batch])))
    assert time.process_time() - began < 5 and sum(b.num_rows for b in out) == 0  # 1.1 million pairs


def test_lines_of_a_band_against_all_pairs():
    rng = np.random.RandomState(4)
    base = [rng.randint(0, 200, 30) for _ in range(12)]
    grams = [np.where(rng.rand(30) < rng.rand() / 3, rng.randint(0, 200, 30), base[i % 12]) for i in range(120)]
    c, key = np.repeat([1, 2], 60), rng.randint(0, 3, (120, 2)).astype(np.int32)
    batch = pa.record_batch({"line": pa.array(range(120)), "c": pa.array(c), "bands": pa.array(key.tolist(), pa.list_(pa.int32())), "grams": pa.array(grams, pa.list_(pa.int64()))})
    got = {x: y for b in P._clusters(0.6, 2)(iter([batch])) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    root = np.arange(120)
    for x in range(120):
        for y in range(x):
            a, b = set(grams[x]), set(grams[y])
            if c[x] == c[y] and (key[x] == key[y]).any() and len(a & b) >= 0.6 * len(a | b):
                u, v = sorted((root[x], root[y]))
                root[root == v] = u
    assert got == {i: int(root[i]) for i in range(120) if (root == root[i]).sum() > 1} and len(got) > 20


def test_texts_of_one_mark_are_left_alone(spark, monkeypatch):
    """With marks of a few values, texts that only share a mark are not cut by each other's spans."""
    rng = random.Random(8)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    r = own(60)
    rows = [(i, f"{own(30)} {r} {own(30)}") for i in range(12)]
    monkeypatch.setattr(P, "text_mark", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in P.dedup(docs).collect()}
    assert all(out[i] == t or out[i] == t.replace(r, "") for i, t in rows) and any(r in t for t in out.values())


def test_only_the_spans_are_left_on_disk(spark):
    """Of the tables that repeats() writes, its spans and the texts that occur twice stay."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("ql-*"))
    rng = random.Random(5)
    passage = prose(rng, 11)
    rows = [(i, f"{prose(rng, 6)} {passage} {prose(rng, 6)}") for i in range(6)]
    out = P.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    left = set(shared.glob("ql-*")) - before
    assert len(left) <= 5 and out.count() == 5  # the nodes of components() are the others
