"""Sharding by longest-processing-time scheduling.

Rows of one group (equal texts) must share a shard. All groups, sorted by size,
go to the least-loaded shard through a heap. Groups of one size are alike to the
schedule, so the driver needs no more of them than their number: it schedules
(size, count) classes, whole turns of equal groups at once, and says for each
class which ranks go to which shard. Groups are ranked within their class on the
cluster. Distinct sizes that sum to at most ``total`` bytes number at most
sqrt(2 x total), 14 million for 100 TB; texts of up to 1 MB with few copies have
far fewer.

A group that is larger than a shard's share makes its shard the largest: no
placement that keeps the group whole does better.

Defined cases: a null text weighs 1 byte like an empty one and shares its
group; equal sizes go by key; repeated rows stay together and are numbered in
any order; an empty table gives no rows; columns of the input pass through.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, read_table, sealed

#: Classes up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 16384


def lpt(classes: list[tuple[int, int]], n_shards: int) -> dict[int, list[tuple[int, int]]]:
    """(size, count) classes -> for each size, runs (end rank, shard) of its groups: largest first, each to the least-loaded shard."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed: dict[int, list[tuple[int, int]]] = {}
    for size, count in sorted(classes, reverse=True):
        runs, at = placed.setdefault(size, []), 0
        while at < count:
            # The lowest shards, within a size of each other, take turns up to the next one's load.
            low = [heapq.heappop(heap)]
            while heap and heap[0][0] < low[0][0] + size:
                low.append(heapq.heappop(heap))
            turns = (count - at) // len(low)
            if heap:
                turns = min(turns, (heap[0][0] - low[-1][0]) // size)
            left = 0 if turns else 1
            for i, (load, shard) in enumerate(low):
                n = turns + (i < left)
                if n:
                    at += n
                    runs.append((at, shard))
                heapq.heappush(heap, (load + n * size, shard))
    return placed


def assign_shards(rows: DataFrame, key: str, size: str, n_shards: int) -> DataFrame:
    """Adds ``shard`` to ``rows`` (which have a long group ``key`` and a long ``size`` of 1 or more)."""
    spark = rows.sparkSession
    groups = cut(rows.groupBy(F.col(key).alias("unit_key")).agg(F.sum(size).alias("unit_size")))
    placed = lpt([(r[0], r[1]) for r in groups.groupBy("unit_size").count().collect()], n_shards)
    table = spark.createDataFrame([(s, [e for e, _ in runs], [x for _, x in runs]) for s, runs in placed.items()], "class_size long, run_ends array<long>, run_shards array<int>")
    ranked = number_rows(groups, "unit_size", ["unit_key"], "unit_rank")
    dealt = ranked.join(F.broadcast(table) if len(placed) <= BROADCAST_ROWS else table, F.col("unit_size") == F.col("class_size"))
    shard = F.get(F.col("run_shards"), F.size(F.filter("run_ends", lambda e: e <= F.col("unit_rank"))))
    return rows.join(dealt.select("unit_key", shard.alias("shard")), F.col(key) == F.col("unit_key")).drop("unit_key")


def number_rows(rows: DataFrame, group: str, order: list[str], name: str, per_part: int = 50_000) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, without a task that holds a whole group."""
    n = rows.count()
    parts = max(16, -(-n // per_part))
    cells = rows.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = cells.groupBy(group, "cell").count()
    starts = counts.select(
        F.col(group).alias("g2"),
        F.col("cell").alias("c2"),
        F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    numbered = cells.withColumn("rn", F.row_number().over(Window.partitionBy(group, "cell").orderBy(*order)) - 1)
    return numbered.join(starts, (F.col(group) == F.col("g2")) & (F.col("cell") == F.col("c2"))).withColumn(name, (F.col("start") + F.col("rn")).cast("long")).drop("cell", "g2", "c2", "start", "rn")


def shard(docs: DataFrame, n_shards: int, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the shard of each row; equal texts share one. Ready for ``write.partitionBy("shard")``."""
    inner, name, restore = sealed(docs)
    text = F.coalesce(F.col(name(text_col)), F.lit(""))
    rows = inner.withColumns({"group_key": F.xxhash64(text), "size": (F.octet_length(text) + 1).cast("long")})
    return restore(assign_shards(rows, "group_key", "size", n_shards).drop("group_key", "size"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group_key"),
        )
    )
    placed = assign_shards(slim, "group_key", "size", 8)
    numbered = number_rows(placed, "shard", ["doc_id", "group_key", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
