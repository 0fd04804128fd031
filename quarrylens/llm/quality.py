"""Operator 5: a quality classifier in a hierarchical empirical Bayes model.

A logistic classifier, fitted on a bounded sample of labelled documents, gives each document's evidence: the log of how much likelier it is
to be good than its features' prior. Hosts and paths are the document's neighbourhood: a host's share of good documents is a beta
posterior around the global share, a path's one around its host's, and how hard sparse sites shrink is estimated from how much the
sites differ beyond what chance explains (moments, by grouped aggregation). A document's posterior is its evidence on the odds of its path
as the others there make them: its own chance is left out of its path, its host and the whole, so that no evidence counts twice.

Defined results: null texts have the features of empty ones. A null host or path is a site of its own. With no labels, or labels of one
kind, the evidence is 0 and the prior one half; so is the prior of the only document there is. Texts of any length are read whole. A
posterior of just keep_at keeps. Repeated rows count each time. A label given twice to an id counts as the lower one.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.textblock import blocks, col, eased, raw, span_hash, word_spans
from quarrylens.runtime import materialize, ship, small_side

SAMPLE = 4000  # labelled documents to fit on, about
BUCKETS = 512
DENSE = 12
KEEP = 0.5


def features(col: pa.Array) -> np.ndarray:
    """(texts, DENSE + BUCKETS): shares of kinds of signs, sizes, repetition, and hashed word endings."""
    data, offs = raw(col)
    n = len(offs) - 1
    size = np.maximum(1, np.diff(offs)).astype(float)
    out = np.zeros((n, DENSE + BUCKETS), np.float32)

    def share(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offs[1:]] - c[offs[:-1]]) / size

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    other = (data > 32) & (data < 127) & ~upper & ~lower & ~digit
    plain = np.isin(data, [44, 46, 39, 45])
    for k, mask in enumerate((upper, lower, digit, other & ~plain, plain, data == 10, data >= 128)):
        out[:, k] = share(mask) * 10
    starts, ends, doc = word_spans(data, offs)
    words = np.bincount(doc, minlength=n)
    out[:, 7] = np.log1p(size) / 3
    out[:, 8] = np.log1p(words) / 3
    out[:, 9] = np.bincount(doc, ends - starts, n) / np.maximum(1, words) / 5
    if len(starts):
        h = span_hash(data, starts, ends)
        pair = _distinct(doc, h)
        out[:, 10] = np.bincount(pair, minlength=n) / np.maximum(1, words) * 3
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, 11] = np.bincount(doc, same, n) / np.maximum(1, words) * 10
        tail = np.zeros(len(h), np.int64)
        for back in range(1, 4):
            at = ends - back
            tail = tail * 257 + np.where(at >= starts, data[np.maximum(at, 0)], 0)
        bucket = (tail * 2654435761 >> 7) % BUCKETS
        flat = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, DENSE:] = np.sqrt(flat / np.maximum(1, words)[:, None]) * 3
    return out


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The text of each distinct (text, word)."""
    o = np.lexsort((h, doc))
    d, w = doc[o], h[o]
    new = np.ones(len(o), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    return d[new]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method, classes weighed alike: weights and intercept, as evidence (log likelihood ratio)."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]), 0.0
    a = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float, float]:
    """Weights, intercept and the share of good documents of the labels; fitted on about `sample` of them, chosen by hash."""
    ship(docs.sparkSession)
    known = labels.where(col(doc_id).isNotNull() & col(label).isin(0, 1)).groupBy(col(doc_id).alias("id")).agg(F.min(col(label)).alias("y"))
    total, good = known.agg(F.count("*"), F.coalesce(F.avg("y"), F.lit(0.5))).first()
    if not total:
        return np.zeros(DENSE + BUCKETS), 0.0, 0.5
    some = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < min(1.0, sample / total) * (1 << 20))
    some = F.broadcast(some)  # `sample` ids, about
    rows = docs.select(col(doc_id).alias("id"), col(text).alias("text")).join(some, "id").select("y", "text")

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                x = features(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["y", "x"])

    got = rows.mapInArrow(eased(run), "y int, x array<float>").toArrow()
    if not got.num_rows:
        return np.zeros(DENSE + BUCKETS), 0.0, 0.5
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(got.num_rows, -1)
    w, b = fit(x, np.asarray(got["y"]))
    return w, b, float(good)


def evidence(docs: DataFrame, model: tuple[np.ndarray, float, float], text: str, keep: list[str]) -> DataFrame:
    """The columns keep with evidence double."""
    ship(docs.sparkSession)
    w, b0, _ = model
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("evidence", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "__text"):
                e = np.clip(features(b.column(len(keep))) @ w + b0, -12, 12)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(e)], [*keep, "evidence"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(eased(run), schema)


def _strength(sites: DataFrame, centre) -> F.Column:
    """Prior observations of sites around their centres, by moments: columns n and good hold documents and expected good ones."""
    mean = F.col("good") / F.col("n")
    noise = F.sum(centre * (1 - centre))
    spread = F.sum(F.col("n") * (mean - centre) ** 2)
    within = F.sum(F.col("n") * centre * (1 - centre))
    between = F.greatest((spread - noise) / F.sum("n"), F.lit(1e-6))
    return F.least(F.greatest(within / F.sum("n") / between - 1, F.lit(1.0)), F.lit(1e6))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", keep_at: float = KEEP) -> DataFrame:
    """(doc_id, evidence, host_share, path_share, posterior, keep) of every document."""
    model = train(docs, labels, doc_id=doc_id, text=text)
    prior = min(max(model[2], 0.01), 0.99)
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(col(path).cast("string"), F.lit("")).alias("path"), col(text).alias("body"))
    scored = materialize(evidence(rows, model, "body", ["doc_id", "host", "path"]))
    chance = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(float(np.log(prior / (1 - prior)))))))
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance).alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    whole = F.broadcast(hosts.agg(F.sum("host_good").alias("all_good"), F.sum("host_n").alias("all_n")))  # one row
    hosts = hosts.crossJoin(whole).withColumns({"n": F.col("host_n"), "good": F.col("host_good"), "share": F.col("all_good") / F.col("all_n")})
    strength = F.broadcast(hosts.agg(_strength(hosts, F.col("share")).alias("host_k")))  # one row
    hosts = hosts.crossJoin(strength).withColumn("host_share", (F.col("share") * F.col("host_k") + F.col("host_good")) / (F.col("host_k") + F.col("host_n"))).drop("n", "good", "share")
    sites = paths.join(hosts, "host")
    strength = F.broadcast(sites.agg(_strength(sites, F.col("host_share")).alias("path_k")))  # one row
    sites = sites.crossJoin(strength).withColumn("path_share", (F.col("host_share") * F.col("path_k") + F.col("good")) / (F.col("path_k") + F.col("n")))
    if small_side(paths):
        sites = F.broadcast(sites)
    out = scored.join(sites, ["host", "path"]).withColumn("own", chance)
    others = lambda prior, k, good, n: (prior * F.col(k) + F.greatest(F.col(good) - F.col("own"), F.lit(0.0))) / (F.col(k) + F.col(n) - 1)
    share = F.when(F.col("all_n") > 1, F.greatest(F.col("all_good") - F.col("own"), F.lit(0.0)) / (F.col("all_n") - 1)).otherwise(0.5)
    share = others(others(share, "host_k", "host_good", "host_n"), "path_k", "good", "n")
    share = F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(share / (1 - share)))))
    return out.select("doc_id", "evidence", "host_share", "path_share", posterior.alias("posterior"), (posterior >= keep_at).alias("keep"))
