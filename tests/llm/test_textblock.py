"""Text kernels against plain Python, and the memory that they take and keep."""

import tracemalloc

import numpy as np
from quarrylens.llm import textblock
from quarrylens.llm.langid import VOCABULARY, evidence, untrained, word_scores
from quarrylens.llm.textblock import BYTE64, MULT, mix, span_hash, word_spans


def plain(data, a, z):
    total = 0
    for v in reversed(BYTE64[data[a:z]].tolist()):
        total = (total * int(MULT) + v) % 2**64
    return mix(np.array([(total + int(z - a) * int(MULT)) % 2**64], np.uint64))[0]


def most(f, *args):
    """Bytes that a call holds at most, its result among them."""
    tracemalloc.start()
    try:
        f(*args)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def text(size, seed=3):
    return np.random.default_rng(seed).choice(np.frombuffer(b"abcdefghij   019\xc3", np.uint8), size)


def test_hashes_are_the_sums_whatever_the_spans():
    data = text(700_000)
    dense = np.arange(0, 700_000, 7)
    for starts, ends in ((dense, dense + 7), (dense[::-1], dense[::-1] + 7), (dense[::50], dense[::50] + 1), (np.array([9, 100, 450_007, 30]), np.array([12, 450_000, 450_009, 300_030]))):
        got = span_hash(data, starts, ends)
        some = range(len(starts)) if len(starts) < 9 else (0, 1, len(starts) // 2, len(starts) - 1)
        assert all(got[k] == plain(data, starts[k], ends[k]) for k in some)
    assert not len(span_hash(data, dense[:0], dense[:0]))


def test_a_worker_keeps_little():
    """Before, 8 bytes for each byte of the longest block, twice, and as much again when a longer one came."""
    for size in (3 << 20, 4 << 20, (4 << 20) - 1, 6 << 20):
        data = text(size)
        span_hash(data, *word_spans(data, np.array([0, size]))[:2])
        span_hash(data, np.array([0]), np.array([size]))
    assert textblock._POW.nbytes + textblock._UNPOW.nbytes <= 16 << 20


def test_a_block_takes_little():
    data = text(4 << 20)
    starts, ends, doc = word_spans(data, np.array([0, len(data)]))
    assert most(span_hash, data, starts, ends) < 64 << 20
    assert most(evidence, data, starts, ends, doc) < 48 << 20
    model = untrained(VOCABULARY, ["w", "x", "y", "z"])
    chars = np.random.default_rng(5).integers(97, 123, 16384 * 32).astype(np.uint32)
    at = np.arange(0, len(chars), 32)
    assert most(word_scores, model, chars, at, np.full(len(at), 32)) < 64 << 20


def test_words_that_tell():
    words = [b"one", b"2", b"a1", b"--", "été".encode(), "日".encode(), b"x", b"9z", b"."]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, doc = evidence(data, *word_spans(data, np.array([0, len(data)])))
    assert [data[a:z].tobytes() for a, z in zip(starts, ends)] == [b"one", "été".encode(), "日".encode(), b"x"]
