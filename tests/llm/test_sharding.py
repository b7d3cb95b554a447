import random
import zlib
from collections import Counter
from itertools import product

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import sharding


def corpus(n=300):
    rnd = random.Random(3)
    texts = ["x" * rnd.randrange(1, 2000) + str(i) for i in range(n // 3)]
    return [(i, rnd.choice(texts)) for i in range(n)]


def test_query(spark, table, docs):
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "é"), (1003, None)]
    got = sharding.op2_sharding(spark, table(docs(rows))).collect()
    text, load, slots, where = dict(rows), [0] * 8, {}, {}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert where.setdefault(raw, r["shard"]) == r["shard"]
    assert len(got) == len(rows) and max(load) - min(load) < 0.05 * sum(load)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def loads_of(placed, shards):
    load, count = [0] * shards, 0
    for size, runs in placed.items():
        at = 0
        for end, shard in runs:
            assert end > at
            load[shard] += size * (end - at)
            at = end
        count += at
    return load, count


def one_by_one(sizes, shards):
    load = [0] * shards
    for s in sorted(sizes, reverse=True):
        load[load.index(min(load))] += s
    return load


@given(st.lists(st.integers(1, 1000) | st.integers(1, 4), max_size=80), st.integers(1, 9))
def test_classes_are_scheduled_like_single_groups(sizes, shards):
    load, count = loads_of(sharding.lpt(list(Counter(sizes).items()), shards), shards)
    assert count == len(sizes) and sorted(load) == sorted(one_by_one(sizes, shards))


def test_millions_of_equal_groups_are_dealt_at_once():
    load, count = loads_of(placed := sharding.lpt([(10**9, 1), (3, 3 * 10**9), (1, 10**7 + 1)], 8), 8)
    assert count == 3 * 10**9 + 10**7 + 2 and max(load) - min(load) <= 3 and sum(map(len, placed.values())) < 100


@given(st.lists(st.integers(1, 60), min_size=1, max_size=7), st.integers(2, 3))
def test_schedule_bound(sizes, shards):
    """The largest shard is at most 4/3 of the best possible."""
    best = min(max(sum(s for s, x in zip(sizes, where, strict=True) if x == k) for k in range(shards)) for where in product(range(shards), repeat=len(sizes)))
    load, _ = loads_of(sharding.lpt(list(Counter(sizes).items()), shards), shards)
    assert 3 * max(load) <= 4 * best


def test_one_group_holds_a_third(docs):
    rows = [(i, "same" * 100 if i % 3 == 0 else f"own {i}" * 40) for i in range(600)]
    got = sharding.shard(docs(rows), 4).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct(F.col("text") == "same" * 100).alias("k")).collect()
    assert len(got) == 4 and sharding.shard(docs(rows), 4).where(F.col("text") == "same" * 100).select("shard").distinct().count() == 1


def test_odd_rows(spark, table, docs):
    clash = docs([(1, "a"), (1, "a"), (None, None)]).withColumn("size", F.lit(1)).withColumn("shard", F.lit("mine"))
    out = sharding.shard(clash, 3)
    assert out.columns == [*clash.columns, "_shard"] and out.count() == 3
    assert sharding.op2_sharding(spark, table(docs([]))).count() == 0
    assert sharding.op2_sharding(spark, table(docs([(None, "x"), (None, "x")]))).count() == 2
