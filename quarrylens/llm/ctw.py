"""Operator 10: LM scoring by context-tree weighting.

A byte is eight binary decisions, each made at a node of a binary tree of the bits before it; every node has a context tree over the
preceding bytes, to depth DEPTH. Spark counts the bytes after each context over the whole corpus. At every context the bits' counts
give a Krichevsky-Trofimov estimate, and the tree's weighted probability is half that estimate and half the product of what the contexts
one byte longer give, from the deepest up. A bit's probability then mixes the estimates of all depths along its context, each depth
by its posterior weight. A text's score is the mean code length of its bytes, in bits.

Defined results: a null text has no score; an empty text is its end alone, whose cost it has. Texts begin after DEPTH begin signs and end
with an end sign, which counts as a byte; the signs of code 2 and 3 in a text are the same as these. Repeated rows count as often as they
occur and get the same score; texts of any length are read whole. An empty table gives no rows. Extra columns are ignored, whatever their
names. Texts that are no part of the corpus are not scored: a byte that was never counted raises an error. Depths beyond 6 are refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.bytegrams import gathered, gram_counts, score_rows
from quarrylens.llm.textblock import col

DEPTH = 4
HALF = np.log(0.5)


@lru_cache(1)
def _log_gamma_half() -> np.ndarray:
    return np.concatenate([[np.log(np.pi) / 2], np.log(np.pi) / 2 + np.cumsum(np.log(np.arange(1 << 16) + 0.5))])


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2): exact sums for small n, Stirling's series for the rest."""
    table = _log_gamma_half()
    x = n + 0.5
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1)], far)


def log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    near = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 256, near[np.minimum(n, 255)], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - np.log(np.pi) - log_factorial(zeros + ones)


@dataclass
class Tree:
    """keys: (context, byte) n-grams, sorted; bits: the code length of the byte after the context."""

    keys: np.ndarray
    bits: np.ndarray


def weigh(keys: np.ndarray, counts: np.ndarray, depth: int) -> Tree:
    """Code lengths of all counted bytes, from sorted n-grams of depth + 1 bytes."""
    levels = [(keys, counts, np.arange(len(keys)))]
    for d in range(depth - 1, -1, -1):
        k, c, _ = levels[0]
        less, up = np.unique(k & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.insert(0, (less, np.bincount(up, c, len(less)).astype(np.int64), up))
    # levels[d]: n-grams of d context bytes and a byte; the last array of levels[d] leads from level d + 1 to d
    ups = [levels[d][2] for d in range(depth)]
    total = np.zeros(len(keys))
    for bit in range(8):
        nodes = []  # by depth: node of each n-gram, zeros, ones
        for k, c, _ in levels:
            node = k >> (8 - bit)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            of = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]]))
            one = (k >> (7 - bit)) & 1
            ones = np.add.reduceat(c * one, first)
            nodes.append((of, np.add.reduceat(c, first) - ones, ones, first))
        weight, below = [None] * (depth + 1), None
        for d in range(depth, -1, -1):
            of, zeros, ones, first = nodes[d]
            own = log_kt(zeros, ones)
            if d == depth:
                weight[d], below = np.ones(len(own)), own
                continue
            child_first = nodes[d + 1][3]
            parent = of[ups[d][child_first]]
            split = np.bincount(parent, below, len(own))
            below = np.logaddexp(HALF + own, HALF + split)
            weight[d] = np.exp(HALF + own - below)
        at = np.arange(len(keys))
        paths = [at]
        for d in range(depth - 1, -1, -1):
            at = ups[d][at]
            paths.insert(0, at)
        p = None
        for d in range(depth, -1, -1):
            of, zeros, ones, _ = nodes[d]
            node = of[paths[d]]
            own = (np.where((levels[depth][0] >> (7 - bit)) & 1, ones[node], zeros[node]) + 0.5) / (zeros[node] + ones[node] + 1.0)
            p = own if p is None else weight[d][node] * own + (1 - weight[d][node]) * p
        total -= np.log2(p)
    return Tree(keys, total.astype(np.float32))


def _cost(tree: Tree, part: str, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(tree.keys, keys), len(tree.keys) - 1)
    if (tree.keys[at] != keys).any():
        raise ValueError("a text holds a byte after a context that the corpus doesn't have")
    return tree.bits[at].astype(np.float64)


def code_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, bits_per_byte) of every document, under the context trees of all of them."""
    if not 0 <= depth <= 6:
        raise ValueError("depth must be 0 to 6")
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    keys, counts = gathered(gram_counts(rows.withColumn("text", F.coalesce("text", F.lit(""))), depth + 1)).get("", (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    tree = weigh(keys, counts, depth) if len(keys) else Tree(keys, np.zeros(0, np.float32))
    return score_rows(rows, depth + 1, docs.sparkSession.sparkContext.broadcast(tree), _cost, "bits_per_byte", keep=["doc_id"])
