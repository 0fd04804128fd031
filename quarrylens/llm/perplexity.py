"""Operator 4: quality rules by n-gram perplexity.

A byte 5-gram model with modified Kneser-Ney smoothing for each language, counted by Spark over all texts, kept in sorted arrays of exact
keys (the bytes themselves) that a binary search reads. Each text's perplexity is held against the band of its language: from the
quartiles of the logarithms of all its texts' perplexities, WIDE interquartile ranges beyond either side. Below the band are texts too
uniform to tell anything, above it those unlike the language.

Defined results: a null or blank text has null perplexity and is rejected; the end of a text counts as a sign; the signs of code 2 and 3 in a
text are the same as its begin and end marks. Repeated rows count as often as they occur. Perplexities of just a limit are accepted. Texts of
any length are read whole. A null language is a language
of its own, "". A language whose texts all have one perplexity accepts those. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.bytegrams import gathered, gram_counts, score_rows
from quarrylens.llm.textblock import col

ORDER = 5
WIDE = 3.0
ACCURACY = 10_000  # a quartile's rank is right to one part in so many; what is held does not grow with the language
LEAST = 0.02  # of a logarithm: the least half-width of a band
ERRORS = 4.0  # over the root of a text's bytes: what a band is wider for a short text, whose mean is less sure


@dataclass
class KneserNey:
    """Of each order from 1: sorted keys and the natural log probability of the last byte after the others; and, of contexts of one
    byte less, sorted keys and the log weight of the lower order."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]

    def score(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Natural log probabilities of the last bytes of n-grams, seen or not."""
        if not order:
            return np.full(len(keys), -np.log(256.0))
        have = self.keys[order - 1]
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        out = self.logp[order - 1][at].astype(np.float64)
        miss = np.flatnonzero(have[at] != keys)
        if len(miss):
            k = keys[miss]
            c = self.contexts[order - 1]
            at = np.minimum(np.searchsorted(c, k >> 8), len(c) - 1)
            weight = np.where(c[at] == k >> 8, self.back[order - 1][at], 0.0)
            out[miss] = weight + self.score(k & ((1 << 8 * (order - 1)) - 1), order - 1)
        return out


def kneser_ney(keys: np.ndarray, counts: np.ndarray, order: int) -> KneserNey:
    """The model of the sorted n-grams of the highest order and their counts."""
    levels = [(keys, counts)]
    for n in range(order - 1, 0, -1):
        levels.insert(0, np.unique(levels[0][0] & ((1 << 8 * n) - 1), return_counts=True))
    model = KneserNey([], [], [], [])
    for n, (k, c) in enumerate(levels, 1):
        ones = [int((c == i).sum()) for i in range(1, 5)]
        y = ones[0] / max(1, ones[0] + 2 * ones[1])
        discount = np.zeros(4)
        for i in range(1, 4):
            d = i - (i + 1) * y * ones[i] / ones[i - 1] if ones[i - 1] else 0.5 * i
            discount[i] = min(max(d, 0.05 * i), 0.95 * i)
        kind = np.minimum(c, 3)
        context = k >> 8
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        total = np.add.reduceat(c, first).astype(float)
        freed = np.add.reduceat(discount[kind], first) / total
        size = np.diff(np.append(first, len(k)))
        lower = np.exp(model.score(k & ((1 << 8 * (n - 1)) - 1), n - 1))
        p = (c - discount[kind]) / np.repeat(total, size) + np.repeat(freed, size) * lower
        model.keys.append(k)
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(context[first])
        model.back.append(np.log(freed).astype(np.float32))
    return model


def _cost(models: dict[str, KneserNey], part: str, keys: np.ndarray) -> np.ndarray:
    return -models[part].score(keys, ORDER)


def perplexities(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns keep with log_perplexity double, by models counted over docs itself."""
    named = docs.where(F.col(text).rlike(r"\S"))
    models = {name: kneser_ney(k, c, ORDER) for name, (k, c) in gathered(gram_counts(named, ORDER, text, lang)).items()}
    shared = docs.sparkSession.sparkContext.broadcast(models)
    blank = docs.withColumn(text, F.when(F.col(text).rlike(r"\S"), F.col(text)))
    return score_rows(blank, ORDER, shared, _cost_or_none, "log_perplexity", text, lang, keep)


def _cost_or_none(models: dict[str, KneserNey], part: str, keys: np.ndarray) -> np.ndarray:
    return _cost(models, part, keys) if part in models else np.zeros(len(keys))


def perplexity_bands(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", wide: float = WIDE) -> DataFrame:
    """(doc_id, lang, perplexity, lower, upper, accepted) of every document."""
    from quarrylens.runtime import materialize

    scored = docs.select(col(doc_id).alias("doc_id"), col(lang).alias("lang"), col(text).alias("text"), F.octet_length(col(text)).alias("size"))
    scored = materialize(perplexities(scored, "text", "lang", ["doc_id", "lang", "size"]))
    part = F.coalesce("lang", F.lit(""))
    bands = scored.groupBy(part.alias("part")).agg(F.percentile_approx("log_perplexity", [0.25, 0.75], ACCURACY).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    reach = (high - low) * wide + LEAST
    bands = F.broadcast(bands.select("part", (low - reach).alias("least"), (high + reach).alias("most")))
    slack = F.lit(ERRORS) / F.sqrt(F.col("size") + 1)
    out = scored.withColumn("part", part).join(bands, "part", "left").withColumn("perplexity", F.exp("log_perplexity"))
    out = out.withColumn("lower", F.exp(F.col("least") - slack)).withColumn("upper", F.exp(F.col("most") + slack))
    return out.select("doc_id", "lang", "perplexity", "lower", "upper", F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(False)).alias("accepted"))
