"""Every query of the catalog against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tidemark import catalog

D = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "tinyint": "TINYINT", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    return c


def plain(x):
    return round(x, 9) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.sql(catalog.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {k: TYPES.get(v, v.upper()) for k, v in df.dtypes} == kinds
    at = [want.columns.index(n) for n in names]
    assert sorted(map(repr, (tuple(plain(r[n]) for n in names) for r in rows))) == sorted(map(repr, (tuple(plain(r[i]) for i in at) for r in want.fetchall())))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_snapshot_filter_and_key_filter_reach_the_scan(spark, tmp_path):
    from tidemark.plans import visibility

    catalog.ev(spark, D).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = visibility.visible(log, 50).where("key = 'user000001'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,user000001)" in plan and "LessThanOrEqual(seq,50)" in plan


def test_newest_wins_plans_a_group_limit(spark):
    from tidemark.plans import visibility

    plan = visibility.visible(catalog.ev(spark, D))._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_varint_codec_of_any_length(spark, tmp_path):
    from tidemark.functions import codecs

    keys = [k for b in range(7, 64, 7) for k in ((1 << b) - 1, 1 << b) if k < 1 << 63] + [0, (1 << 63) - 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r["n"], r["back"], r["encoded"]) for r in catalog.QUERIES["varint_codec"](spark, str(tmp_path)).collect())
    assert got == sorted((k, k, codecs.varint(k).hex().upper()) for k in keys)


@pytest.mark.parametrize("name", ["bloom_no_false_negative", "bloom_false_positives"])
def test_bloom_filters_stay_bounded(spark, tmp_path, monkeypatch, name):
    """Files of 12500 keys have filters of fewer; Python sees keys and hashes, never a filter beside each row."""
    from tidemark.functions import bloom

    n, seen, make = 100_000, [], bloom.filters
    spark.range(n).selectExpr("id as o_orderkey", "1.0D as o_totalprice", "'O' as o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(bloom, "filters", lambda *a, **k: seen.append(made := make(*a, **k)) or made)
    got = catalog.QUERIES[name](spark, str(tmp_path))
    keys = [r["keys"] for r in getattr(seen[0], "table", seen[0]).select("keys").collect()]
    assert max(keys) < 10_000 and n - 5 <= sum(keys) <= n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [line.split("[")[1].split("(")[0] for line in plan.splitlines() if "ArrowEvalPython" in line] == ["_hash"]
    if name == "bloom_false_positives":
        assert [r["rare"] for r in got.collect()] == [True]
    else:
        assert got.where("hit").count() == got.count() == n
