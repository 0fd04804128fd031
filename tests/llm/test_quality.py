import numpy as np
from pyspark.sql import functions as F
from quarrylens.llm.quality import classify, fit, train


def test_fit_recovers_a_separating_direction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = (x[:, 0] - x[:, 1] + rng.normal(scale=0.3, size=2000) > 0).astype(int)
    w, b = fit(x, y)
    assert w[0] > 1 and w[1] < -1 and np.abs(w[2:]).max() < 0.5
    assert fit(x, np.ones(2000))[0].any() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = classify(docs, labels.where(~held)).join(labels.where(held), "doc_id").toPandas()
    good = out[out["quality"] == 1]["posterior"].to_numpy()
    bad = out[out["quality"] == 0]["posterior"].to_numpy()
    rank = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    assert rank > 0.75


def test_sparse_sites_shrink(spark):
    """The shares by hand: grouped sums of the documents' own chances, shrunk towards the host and the whole."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").toPandas()
    prior = train(docs, labels)[2]
    out["chance"] = 1 / (1 + np.exp(-(out["evidence"] + np.log(prior / (1 - prior)))))
    whole = out["chance"].mean()
    host = out.groupby("source").agg(n=("chance", "size"), mean=("chance", "mean"), share=("host_share", "first"))
    between = ((host["share"] - whole) * (host["mean"] - whole) >= -1e-9).all() and ((host["share"] - whole).abs() <= (host["mean"] - whole).abs() + 1e-9).all()
    assert between
    k = (host["share"] - host["mean"]) * host["n"] / (whole - host["share"])
    assert np.allclose(k, k.median(), rtol=1e-3)
    path = out.groupby(["source", "lang"]).agg(n=("chance", "size"), mean=("chance", "mean"), share=("path_share", "first"), host=("host_share", "first"))
    far = path[(path["host"] - path["share"]).abs() > 1e-6]
    k = (far["share"] - far["mean"]) * far["n"] / (far["host"] - far["share"])
    assert np.allclose(k, k.median(), rtol=1e-2)
    # strengths by hand, and posteriors with a document's own chance left out of its sites

    def strength(n, good, centre):
        mean = good / n
        between = max((np.sum(n * (mean - centre) ** 2) - np.sum(centre * (1 - centre))) / n.sum(), 1e-6)
        return min(max(np.sum(n * centre * (1 - centre)) / n.sum() / between - 1, 1.0), 1e6)

    n_h, good_h = host["n"].to_numpy(), (host["n"] * host["mean"]).to_numpy()
    k_h = strength(n_h, good_h, np.full(len(n_h), whole))
    assert np.allclose(host["share"], (whole * k_h + good_h) / (k_h + n_h))
    n_p, good_p = path["n"].to_numpy(), (path["n"] * path["mean"]).to_numpy()
    k_p = strength(n_p, good_p, path["host"].to_numpy())
    assert np.allclose(path["share"], (path["host"] * k_p + good_p) / (k_p + n_p))
    c, by_host, by_path = out["chance"], out.groupby("source")["chance"], out.groupby(["source", "lang"])["chance"]
    share = (c.sum() - c) / (len(c) - 1)
    share = (share * k_h + by_host.transform("sum") - c) / (k_h + by_host.transform("size") - 1)
    share = (share * k_p + by_path.transform("sum") - c) / (k_p + by_path.transform("size") - 1)
    assert np.allclose(out["posterior"], 1 / (1 + np.exp(-(out["evidence"] + np.log(share / (1 - share))))))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (5, 0), (None, 1), (8, None), (77, 0)], "doc_id long, quality int")
    odd = odd.withColumns({c: F.lit("x") for c in ("__y", "__id", "a.b", "evidence", "n", "good", "id", "y")})
    none = odd.limit(0)
    out = classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["posterior"] <= 1 for r in out)
    assert classify(none, labels).count() == 0
    neutral = classify(odd, labels.limit(0)).collect()
    assert len(neutral) == odd.count() and all(abs(r["evidence"]) < 1e-9 and abs(r["posterior"] - 0.5) < 1e-6 for r in neutral)


def test_real_hosts_and_paths(spark):
    """Paths lie under their hosts: the same path of another host is another site."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    k = F.pmod("doc_id", F.lit(4))
    docs = docs.withColumns({"host": F.when(k < 2, "a.example").otherwise("b.example"), "path": F.when(k % 2 == 0, "/blog").otherwise("/shop")})
    out = classify(docs, labels, host="host", path="path").join(docs.select("doc_id", "host", "path"), "doc_id").toPandas()
    assert len(out) == docs.count()
    assert (out.groupby("host")["host_share"].nunique() == 1).all() and out["host_share"].nunique() == 2
    assert (out.groupby(["host", "path"])["path_share"].nunique() == 1).all() and out["path_share"].nunique() == 4
