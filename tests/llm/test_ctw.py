import math
from collections import Counter, defaultdict

import numpy as np
from quarrylens.llm.ctw import DEPTH, code_lengths, log_factorial, log_gamma_half, weigh

TEXTS = ["banana", "bandana", "ban", "", "banana"]


def grams(text, depth):
    padded = [2] * depth + list(text.encode()) + [3]
    return [tuple(padded[i : i + depth + 1]) for i in range(len(padded) - depth)]


def brute(texts, depth):
    """Bits of a byte after a context, by recursion over explicit trees."""
    counts = defaultdict(lambda: [0, 0])  # (bits so far, context) -> zeros, ones
    children = defaultdict(set)
    for g, n in Counter(g for t in texts for g in grams(t, depth)).items():
        bits = f"{g[-1]:08b}"
        for b in range(8):
            for d in range(depth + 1):
                context = g[depth - d : depth]
                counts[bits[:b], context][int(bits[b])] += n
                if d:
                    children[bits[:b], context[1:]].add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def pw(node, context):
        own = kt(*counts[node, context])
        if len(context) == depth:
            return own
        below = sum(pw(node, c) for c in children[node, context])
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)

    def cost(g):
        bits, total = f"{g[-1]:08b}", 0.0
        for b in range(8):
            p = None
            for d in range(depth, -1, -1):
                context = g[depth - d : depth]
                c = counts[bits[:b], context]
                own = (c[int(bits[b])] + 0.5) / (sum(c) + 1)
                if p is None:
                    p = own
                else:
                    w = math.exp(math.log(0.5) + kt(*c) - pw(bits[:b], context))
                    p = w * own + (1 - w) * p
            total -= math.log2(p)
        return total

    return cost


def test_trees_against_recursion():
    depth = 2
    c = Counter(int.from_bytes(bytes(g), "big") for t in TEXTS for g in grams(t, depth))
    keys = np.array(sorted(c), np.int64)
    tree = weigh(keys, np.array([c[int(k)] for k in keys]), depth)
    cost = brute(TEXTS, depth)
    for k, bits in zip(tree.keys.tolist(), tree.bits.tolist()):
        assert math.isclose(bits, cost(tuple(k.to_bytes(depth + 1, "big"))), rel_tol=1e-4)


def test_special_functions():
    n = np.array([0, 1, 7, 255, 256, 70000, 10**8])
    assert np.allclose(log_gamma_half(n), [math.lgamma(x + 0.5) for x in n], rtol=1e-10)
    assert np.allclose(log_factorial(n), [math.lgamma(x + 1) for x in n], rtol=1e-10)


def test_scores_over_spark(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    cost = brute(TEXTS, DEPTH)
    for r in code_lengths(docs).collect():
        own = grams(TEXTS[r["doc_id"]], DEPTH)
        assert math.isclose(r["bits_per_byte"], sum(map(cost, own)) / len(own), rel_tol=1e-4)


def test_noise_costs_more_than_prose(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(0)
    noise = spark.createDataFrame([(10**6, "".join(map(chr, rng.integers(33, 126, 3000))))], docs.schema)
    out = {r["doc_id"]: r["bits_per_byte"] for r in code_lengths(docs.unionByName(noise)).collect()}
    assert out[10**6] > np.median(list(out.values())) + 1


def test_odd_rows(odd, none):
    out = code_lengths(odd).collect()
    assert len(out) == odd.count()
    assert all((r["bits_per_byte"] is None) == (r["doc_id"] == 3) for r in out)
    twice = [r["bits_per_byte"] for r in out if r["doc_id"] == 1]
    assert twice[0] == twice[1]
    assert code_lengths(none).count() == 0
