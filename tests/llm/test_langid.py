import math

import numpy as np
import pytest
import sentencepiece as sp
from pyspark.sql import functions as F
from quarrylens.llm.langid import MARK, UNKNOWN, VOCABULARY, identify, train_pieces, untrained, word_scores


def test_all_segmentations_are_summed():
    m = untrained(VOCABULARY, ["x", "y"])
    rng = np.random.default_rng(1)
    m.prob[1:-1] = rng.random(m.prob[1:-1].shape) * 1e-3
    p = sp.SentencePieceProcessor(model_file=VOCABULARY)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    prob = {x: m.prob[k + 1] for k, x in enumerate(pieces)}

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            q = prob.get(word[:k])
            if q is None and k == 1:
                q = np.full(2, UNKNOWN)
            if q is not None:
                out = out + q * total(word[k:])
        return out

    words = [chr(MARK) + w for w in ("the", "running", "a", "été", "日本x", "qqq")]
    lens = np.array([len(w) for w in words])
    cps = np.array([ord(c) for w in words for c in w], np.uint32)
    got = word_scores(m, cps, np.cumsum(lens) - lens, lens)
    for w, row in zip(words, got):
        assert np.allclose(row, np.log(total(w)))


def test_long_words_are_summed_over_all_segmentations():
    """500 signs and more, no cut anywhere, against the recursion in exact fractions of powers."""
    from fractions import Fraction

    m = untrained(VOCABULARY, ["x", "y"])
    rng = np.random.default_rng(4)
    m.prob[1:-1] = rng.random(m.prob[1:-1].shape) * 1e-3
    p = sp.SentencePieceProcessor(model_file=VOCABULARY)
    prob = {x: m.prob[k + 1] for k, x in enumerate(p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)))}
    longest = max(map(len, prob))
    words = [chr(MARK) + w for w in ("internationalization" * 27, "abc" * 11, "日本語" * 200, "the" * 13, "x" * 33, "short")]
    lens = np.array([len(w) for w in words])
    cps = np.array([ord(c) for w in words for c in w], np.uint32)
    got = word_scores(m, cps, np.cumsum(lens) - lens, lens)
    for w, row in zip(words, got):
        for k in range(2):
            alpha = [Fraction(1)]
            for j in range(1, len(w) + 1):
                total = Fraction(0)
                for size in range(1, min(j, longest) + 1):
                    q = prob.get(w[j - size : j])
                    if q is None and size == 1:
                        q = np.full(2, UNKNOWN)
                    if q is not None:
                        total += alpha[j - size] * Fraction(float(q[k])).limit_denominator(10**18)
                alpha.append(total.limit_denominator(10**3000) if total.denominator > 10**3000 else total)
            want = math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)
            assert math.isclose(row[k], want, rel_tol=1e-6)


def test_expected_counts_against_all_segmentations():
    """The step of the fit: expected counts of pieces, by listing every segmentation."""
    m = untrained(VOCABULARY, ["x", "y"])
    rng = np.random.default_rng(7)
    m.prob[1:-1] = rng.random(m.prob[1:-1].shape) * 1e-3
    p = sp.SentencePieceProcessor(model_file=VOCABULARY)
    row = {x: k + 1 for k, x in enumerate(p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)))}

    def cuts(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            r = row.get(word[:k], 0 if k == 1 else None)
            if r is not None:
                yield from ([r, *rest] for rest in cuts(word[k:]))

    words = [chr(MARK) + w for w in ("there", "abcab", "étude")]
    weight = rng.random((2, 3))
    want = np.zeros_like(m.prob)
    for w, own in zip(words, weight.T):
        every = list(cuts(w))
        chance = np.array([np.prod(m.prob[c], 0) for c in every])
        for c, share in zip(every, chance / chance.sum(0) * own):
            for r in c:
                want[r] += share
    got = m.expect(np.array([[ord(c) for c in w] for w in words], np.uint32).T, weight)
    assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = train_pieces(docs.where(seen), sample=50)
    right, n, ok = identify(docs.where(~seen), model).agg(F.avg((F.col("lid") == F.col("lang")).cast("double")), F.count("*"), F.avg(F.col("lid_ok").cast("double"))).first()
    assert n > 300 and right > 0.98 and ok > 0.99


def test_odd_rows(odd, none):
    rows = identify(odd.withColumns({c: F.lit("x") for c in ("a.b", "c0", "c1", "body", "w")}), train_pieces(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert r["lid"] is None and r["lid_score"] is None and not r["lid_ok"]
        elif r["doc_id"] in (1, 6):
            assert r["lid"] == r["lang"] and r["lid_ok"] and math.isfinite(r["lid_score"])
    assert identify(none, train_pieces(none)).count() == 0
    assert identify(odd, train_pieces(none)).where("lid is not null or lid_ok").count() == 0


def test_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([("same words here", "b"), ("same words here", "a")], "text string, lang string")
    assert {r["lid"] for r in identify(docs, train_pieces(docs)).collect()} == {"a"}


@pytest.mark.parametrize("text", ["", "a", "x" * 500])
def test_scores_are_finite(spark, text):
    docs = spark.createDataFrame([(text, "a"), ("other words", "b")], "text string, lang string")
    for r in identify(docs, train_pieces(docs)).collect():
        assert r["lid_score"] is None or math.isfinite(r["lid_score"])
