from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarrylens.llm.mixing import mix_sources, quotas, split_tree, temperature_weights


def test_quotas():
    assert quotas({"a": 100, "b": 50}, {"a": 1, "b": 1}) == {"a": 50, "b": 50}
    assert quotas({"a": 100, "b": 50, "c": 9}, {"a": 3, "b": 1}) == {"a": 100, "b": 33}
    assert quotas({"a": 3}, {}) == {} and quotas({}, {"a": 1}) == {}
    q = quotas({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 0.5})
    assert q == {"a": 10, "b": 10, "c": 5}
    with pytest.raises(ValueError):
        quotas({"a": 1}, {"a": -1})


def test_split_tree_draws_what_one_shuffled_deck_would():
    have, shards = np.array([40, 20, 7, 1]), 6
    draws = np.stack([split_tree(have, shards, s) for s in range(600)])
    assert (draws.sum(1) == have).all()
    assert draws.sum(2).max() - draws.sum(2).min() <= 2
    mean = have / shards
    assert np.allclose(draws.mean(0), mean, atol=0.35)
    n, size = have.sum(), have.sum() / shards  # hypergeometric variance
    want = size * have / n * (1 - have / n) * (n - size) / (n - 1)
    assert np.allclose(draws.var(0).mean(0), want, rtol=0.25)


def test_exact_quotas_disjoint_blocks_local_places(spark):
    rows = [(i, "ab"[i % 5 == 0]) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mix_sources(docs, {"a": 1, "b": 1}, shards=5, block=8).collect()
    assert Counter(r["source"] for r in got) == {"a": 200, "b": 200} and len({r["doc_id"] for r in got}) == 400
    for s in range(5):
        assert sorted(r["mix_place"] for r in got if r["mix_shard"] == s) == list(range(sum(r["mix_shard"] == s for r in got)))
    blocks = {}
    for r in got:
        blocks.setdefault((r["source"], r["mix_block"]), set()).add(r["mix_shard"])
    assert all(len(x) == 1 for x in blocks.values()) and len(blocks) == 50
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs, {"a": 1, "b": 1}, shards=5, block=8).collect()))


def test_odd_rows(odd, none):
    odd = odd.withColumns({c: F.lit("same") for c in ("__o", "__s", "__take", "__rank", "a.b", "c0", "c1")})
    none = odd.limit(0)
    out = mix_sources(odd, temperature_weights(odd, 1.0), block=2, shards=2)
    assert set(odd.columns) - {"mix_shard"} < set(out.columns) and out.where("`a.b` <> 'same'").count() == 0
    assert out.count() == odd.where("source is not null").count()
    assert out.columns.count("mix_shard") == 1
    assert mix_sources(none).count() == 0 and mix_sources(odd, {"a": 0.0}).count() == 0
    assert {r["source"] for r in mix_sources(odd, {"a": 2.0, "zzz": 5.0}).collect()} == {"a"}


def test_a_tiny_source_and_a_hot_one_lose_nothing(spark):
    """One source of one document bound all others to its share; a hot one lost most of what it had."""
    counts = {"hot": 400, "tiny": 1} | {f"s{k}": 20 for k in range(20)}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mix_sources(docs, temperature_weights(docs), block=8, shards=5, epochs=4).collect()
    times = Counter(r["doc_id"] for r in got)
    assert set(times) == {i for i, _ in rows} and max(times.values()) == 4
    n = Counter(r["source"] for r in got)
    assert n == {"hot": 400, "tiny": 4} | {f"s{k}": 80 for k in range(20)}  # at square roots 20 and 89 would be due: four times at most
    assert len({(r["mix_shard"], r["mix_place"]) for r in got}) == len(got)
    assert quotas({"a": 900, "b": 400}, {"a": 30, "b": 20}, 4) == {"a": 900, "b": 600}
    assert quotas({"a": 9, "b": 1}, {"a": 3, "b": 1, "c": 5}, 4) == {"a": 9, "b": 3}


def test_query_and_pipeline_keep_every_document(spark, tmp_path):
    import corpus_pipeline as C
    from quarrylens.llm.queries import QUERIES

    docs = spark.createDataFrame([(i, f"t {i}", "en", "tiny" if i == 0 else "ab"[i % 5 == 0], 1) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (QUERIES["op6_source_mixing"](spark, str(tmp_path)), C.mixture(spark, docs, str(tmp_path))):
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(range(300))


def test_null_is_a_source_of_its_own(spark, tmp_path):
    from quarrylens.llm.queries import QUERIES

    docs = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(90)], "doc_id long, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(r["source"] for r in QUERIES["op6_source_mixing"](spark, str(tmp_path)).collect()) == {None: 30, "a": 30, "b": 30}
    assert Counter(r["source"] for r in mix_sources(docs, {None: 1, "a": 2}).collect()) == {None: 15, "a": 30}
    assert {r["source"] for r in mix_sources(docs, {"a": 2}).collect()} == {"a"}


def test_the_query_takes_whole_documents(spark, sf):
    from quarrylens.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op6_source_mixing"](spark, sf)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    whole = {tuple(r) for r in docs.collect()}
    assert {tuple(r)[: len(docs.columns)] for r in rows} == whole
    places = Counter(r["mix_shard"] for r in rows)
    for shard, n in places.items():
        assert sorted(r["mix_place"] for r in rows if r["mix_shard"] == shard) == list(range(n))
