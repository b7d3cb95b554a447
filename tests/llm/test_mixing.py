import random

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
from conftest_sf import SF
from tidemark.llm import mixing


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    return [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(40))), "en", rnd.choice(["a", "a", "a", "b", "é", None])) for i in range(n)]


def test_targets_and_taken(spark, table, docs):
    rows = corpus()
    got = mixing.op1_mixing(spark, table(docs(rows))).collect()
    sizes = {s: sum(len(brute.words(r[1])) for r in own) for s, own in brute.by_source(rows, 3).items()}
    want = brute.targets(sizes)
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    assert got == mixing.op1_mixing(spark, table(docs(rows, parts=5))).collect()


def test_sql(spark):
    df = mixing.op1_mixing(spark, SF)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(mixing.OP1_SQL)
    names = sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_schedules_shape_the_order(docs):
    """Sources that fade out come early, sources that fade in late; a step schedule starts where its weight does."""
    rows = [(i, "w " * 10, None, "ab"[i % 2]) for i in range(400)]
    mixed = mixing.mix(docs(rows)).select("doc_id").collect()
    early = [r[0] % 2 for r in mixed[: len(mixed) // 4]]
    assert early.count(0) > 1.1 * early.count(1) / 2 * 1
    late = lambda rank: mixing.knots_column([(F.lit(0.0), F.lit(0.0)), (F.lit(0.5), F.lit(0.0)), (F.lit(0.5), F.lit(1.0)), (F.lit(1.0), F.lit(1.0))])
    planned = mixing.plan_mix(docs(rows), late).select(F.explode("mix_positions").alias("p")).agg(F.min("p"), F.max("p")).first()
    assert planned[0] >= 0.5 and planned[1] <= 1


def test_copies_and_columns(docs):
    rows = [(1, "a b c", None, "small"), *[(10 + i, "a b c d", None, "tall") for i in range(30)]]
    df = docs(rows).withColumn("target", F.lit("t")).withColumn("mix_size", F.lit(7))
    out = mixing.mix(df, max_epochs=3)
    assert out.columns == df.columns
    assert out.where("doc_id = 1").count() == 3
    planned = mixing.plan_mix(df)
    assert "_mix_size" in planned.columns and planned.where("mix_size <> 7").count() == 0


def test_odd_rows(docs):
    rows = [(None, None, None, None), (1, "", None, None), (2, " \n", None, "x"), (2, "one two", None, "y"), (2, "one two", None, "y"), (3, "z " * 50_000, None, "y")]
    got = mixing.plan_mix(docs(rows)).collect()
    assert len(got) == 6 and sorted(r["mix_size"] for r in got) == [0, 0, 0, 2, 2, 50_000]
    assert mixing.plan_mix(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs([(1, None, None, "x")])).count() == 0
