"""Every registered query with SQL gives DuckDB's rows at the smallest scale; plans are checked for Cartesian products."""

import duckdb
import pytest
from quarrylens import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows, columns):
    return sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = [dict(zip(columns, r)) for r in result.fetchall()]
    assert tidy(df.collect(), sorted(columns)) == tidy(want, sorted(columns))
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_findings_of_a_stream_stay_in_files(spark):
    assert registry.QUERIES["scan_over_stream"](spark, SF).inputFiles()


def test_numbers_of_many_suppliers_are_uncommon(spark, tmp_path):
    at = str(tmp_path / "supplier.parquet")
    spark.range(2020, 2040).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(at)
    want = duckdb.sql(registry.ORACLE_SQL["rule_magic_numbers"].replace("FROM supplier", f"FROM '{at}/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["rule_magic_numbers"](spark, str(tmp_path)).collect()) == sorted(want)


def test_a_gate_computes_its_rows_once(spark):
    from quarrylens.operators import report

    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("concat('F-', event_id) AS finding_id", "'high' AS severity", "'new' AS baseline_status", "'none' AS waiver_status", "'runtime-source' AS scope_class", "'native-static' AS owner_lane")
    one = report.gate(rows, report.GatePolicy("high", True))
    assert not [f for f in one.inputFiles() if f.endswith("events.parquet")] and one.first()["blocking_count"] == rows.count()
    assert report.gate(rows.limit(0), report.GatePolicy("high", True)).first()["decision"] == "pass"
