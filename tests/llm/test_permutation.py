import numpy as np
import pytest
from pyspark.sql import functions as F
from quarrylens.llm.permutation import K, Files, nearest, places, prefixes, shape


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    return {int(i): [int(j) for j in ids[np.lexsort((ids, -s))][:k]] for i, s in zip(ids, sim)}


def recall(table, got, ids=None):
    pdf = table.toPandas()
    want = brute(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float), K)
    want = {i: w for i, w in want.items() if ids is None or i in ids}
    found = {}
    for r in got.collect():
        found.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour"]
    assert set(found) <= set(want)
    assert all(sorted(g) == list(range(1, len(g) + 1)) and len(g) <= K for g in found.values())
    return sum(len(set(found.get(i, {}).values()) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_every_row(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    assert recall(table, nearest(table)) >= 0.9


def test_recall_of_the_query(spark):
    table = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    ids = {r[0] for r in table.where("vec_id % 20 = 0").select("vec_id").collect()}
    got = nearest(table, queries=F.col("id") % 20 == 0)
    assert recall(table, got, ids) >= 0.9


def test_salted_parts_give_the_same_recall(spark):
    """A third of all rows are one vector; parts of 100 rows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 1000")
    hot = F.when(F.col("vec_id") % 3 == 0, F.array(*[F.lit(1.0 + k % 5) for k in range(64)]).cast("array<float>")).otherwise(F.col("embedding"))
    table = table.select("vec_id", hot.alias("embedding"))
    parts = {(r["vec_id"], r["rank"]): r["similarity"] for r in nearest(table, cell=100).collect()}
    whole = {(r["vec_id"], r["rank"]): r["similarity"] for r in nearest(table).collect()}
    assert parts == pytest.approx(whole, abs=2e-5)
    assert sorted({r["neighbour"] for r in nearest(table, cell=100).where("vec_id = 999").collect()}) == [3 * i for i in range(10)]


def test_files_against_the_sums_of_minima():
    rng = np.random.default_rng(8)
    order = prefixes(rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(40, 8)).astype(np.float32), 9)
    at = places(order, 40).astype(int)
    files = Files(order, 40)
    for i in range(0, 300, 17):
        sums = np.minimum(at, at[i]).sum(1)
        for least in (1, 12, 30):
            assert files.within(order[i], least).tolist() == np.flatnonzero(sums >= least).tolist()


def test_places_give_the_footrule_distance():
    rng = np.random.default_rng(3)
    x, p = rng.normal(size=(20, 8)), rng.normal(size=(12, 8))
    order = prefixes(x, p, 5)
    at = places(order, 12).astype(int)

    def footrule(a, b):
        place = lambda o, v: list(o).index(v) if v in o else 5
        return sum(abs(place(a, v) - place(b, v)) for v in range(12))

    for i in range(20):
        for j in range(20):
            assert footrule(order[i], order[j]) == 5 * 6 - 2 * np.minimum(at[i], at[j]).sum()


def test_shape_is_bounded():
    assert shape(1)[:2] == (1, 1) and shape(2000)[:2] == (500, 64) and shape(10**9)[:2] == (512, 64) and shape(10**8)[2] == 156


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x"), (3, [0.0, 1.0], None), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [1.0], "x"), (7, [float("nan"), 1.0], "x"), (8, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (2, [0.9, 0.1], "x"), (9, [float("inf"), 0.0], "x"), (10, [1.0, 0.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, similarity string").withColumns({c: F.lit("x") for c in ("id", "v", "n", "cell", "part", "a.b", "__v")})
    out = nearest(table, k=2).collect()
    assert {r["vec_id"] for r in out} <= {1, 2, 3, 10} and {r["neighbour"] for r in out} <= {1, 2, 3, 10}
    first = {r["vec_id"]: r["neighbour"] for r in out if r["rank"] == 1}
    assert first[1] == 10 and first[10] == 1 and first[2] == 1  # a tie goes to the smaller id
    assert nearest(table.limit(0)).count() == 0 and nearest(table.where("vec_id = 1")).count() == 0
