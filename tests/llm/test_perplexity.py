import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from quarrylens.llm.bytegrams import gram_counts, gram_keys
from quarrylens.llm.perplexity import ORDER, kneser_ney, perplexities, perplexity_bands

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "abracadabra", "the cat sat on the mat"]


def grams(text, n):
    padded = [2] * (n - 1) + list(text.encode()) + [3]
    return [tuple(padded[i : i + n]) for i in range(len(padded) - n + 1)]


def brute(texts, n):
    """Modified Kneser-Ney over dictionaries: function of an n-gram to the probability of its last byte."""
    levels = {n: Counter(g for t in texts for g in grams(t, n))}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts, totals, freed = {}, {}, {}
    for k, c in levels.items():
        ones = Counter(c.values())
        y = ones[1] / max(1, ones[1] + 2 * ones[2])
        d = [0.0] + [min(max(i - (i + 1) * y * ones[i + 1] / ones[i] if ones[i] else 0.5 * i, 0.05 * i), 0.95 * i) for i in (1, 2, 3)]
        discounts[k] = d
        totals[k], freed[k] = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            totals[k][g[:-1]] += v
            freed[k][g[:-1]] += d[min(v, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        lower = p(g[1:])
        t = totals[k].get(g[:-1])
        if not t:
            return lower
        v = levels[k].get(g, 0)
        return (v - discounts[k][min(v, 3)]) / t + freed[k][g[:-1]] / t * lower

    return p


def test_model_against_dictionaries():
    c = Counter(int.from_bytes(bytes(g), "big") for t in TEXTS for g in grams(t, ORDER))
    keys = np.array(sorted(c), np.int64)
    model = kneser_ney(keys, np.array([c[int(k)] for k in keys]), ORDER)
    p = brute(TEXTS, ORDER)
    for t in [*TEXTS, "the zebra", "xyz"]:
        own = grams(t, ORDER)
        got = model.score(np.array([int.from_bytes(bytes(g), "big") for g in own], np.int64), ORDER)
        assert np.allclose(np.exp(got), [p(g) for g in own], rtol=1e-4)


def test_counts_and_scores_over_spark(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    want = Counter(int.from_bytes(bytes(g), "big") for t in TEXTS for g in grams(t, ORDER))
    assert {r["key"]: r["n"] for r in gram_counts(docs, ORDER).collect()} == dict(want)
    p = brute(TEXTS, ORDER)
    for r in perplexities(docs).collect():
        own = grams(r["text"], ORDER)
        assert math.isclose(r["log_perplexity"], -sum(math.log(p(g)) for g in own) / len(own), rel_tol=1e-4)


def test_keys_stay_inside_their_texts():
    data = np.frombuffer(b"abcd", np.uint8)
    keys, size = gram_keys(data, np.array([0, 2, 2, 4]), 3)
    assert size.tolist() == [3, 1, 3]
    want = [int.from_bytes(bytes(g), "big") for t in ("ab", "", "cd") for g in grams(t, 3)]
    assert keys.tolist() == want


def test_bands_reject_noise_and_keep_prose(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    noise = spark.createDataFrame([(10**6, "q7#zK!x9@" * 40, "en"), (10**6 + 1, "aaaa " * 300, "en")], docs.schema)
    out = {r["doc_id"]: r for r in perplexity_bands(docs.unionByName(noise)).collect()}
    assert not out[10**6]["accepted"]
    kept = [r["accepted"] for k, r in out.items() if k < 10**6]
    assert sum(kept) / len(kept) > 0.85


def test_odd_rows(odd, none):
    out = perplexity_bands(odd).collect()
    assert len(out) == odd.count()
    assert all(r["perplexity"] is None and not r["accepted"] for r in out if r["doc_id"] in (2, 3, 4))
    assert all(r["perplexity"] > 0 for r in out if r["doc_id"] in (1, 5, 6, 8, 9))
    assert perplexity_bands(none).count() == 0
    one = odd.where("doc_id = 1")
    assert one.count() == 2 and perplexity_bands(one).where(F.col("accepted")).count() == 2
