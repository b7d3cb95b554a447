"""Which version of a key is seen, and which versions there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import BYTEWISE, DEL, PUT, KeyOrder


def as_of(log: DataFrame, snapshot: int | Column | None) -> DataFrame:
    """Rows not newer than ``snapshot``. Belongs below newest-wins: the filter reaches the scan."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """The newest row of each key, tombstones included.

    ``row_number = 1`` plans a partial and a final group limit, so a key with
    very many versions is cut down before the shuffle.
    """
    key = order.column(F.col("key"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return as_of(log, snapshot).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def visible(log: DataFrame, snapshot: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """The state as of ``snapshot``: the newest row of each key, unless it is a tombstone."""
    return newest(log, snapshot, order).where(F.col("op") == PUT)


def tombstones(log: DataFrame, snapshot: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """Keys whose newest row deletes them."""
    return newest(log, snapshot, order).where(F.col("op") == DEL)


def versions(log: DataFrame, order: KeyOrder = BYTEWISE) -> DataFrame:
    """All rows with ``version``: 1 for a key's newest."""
    rank = F.row_number().over(Window.partitionBy(order.column(F.col("key"))).orderBy(F.desc("seq")))
    return log.withColumn("version", rank.cast("long"))


def point_get(log: DataFrame, key: object, snapshot: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """The visible row of one key, or none. Filters reach the scan; one row is sorted out."""
    mine = as_of(log, snapshot).where(order.column(F.col("key")) == F.lit(order.value(key)))
    return mine.orderBy(F.desc("seq")).limit(1).where(F.col("op") == PUT)


def probe(log: DataFrame, key: object, snapshot: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """(key, outcome): found, deleted or absent for one key."""
    mine = as_of(log, snapshot).where(order.column(F.col("key")) == F.lit(order.value(key)))
    op = F.max(F.struct("seq", "op"))["op"]
    outcome = F.when(op == PUT, "found").when(op == DEL, "deleted").otherwise("absent")
    return mine.agg(outcome.alias("outcome")).select(F.lit(key).alias("key"), "outcome")


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """Visible rows of the keys in ``keys`` (column key). The semi-join comes before newest-wins; Spark chooses its kind by size."""
    wanted = keys.select(order.column(F.col("key")).alias("__wanted")).distinct()
    mine = as_of(log, snapshot).join(wanted, order.column(F.col("key")) == F.col("__wanted"), "left_semi")
    return visible(mine, None, order)


def merge_runs(*runs: DataFrame) -> DataFrame:
    """All rows of some runs as one bag, ordered by key and newest first."""
    return reduce(DataFrame.unionByName, runs).orderBy("key", F.desc("seq"))


def changes(log: DataFrame, older: int, newer: int, order: KeyOrder = BYTEWISE) -> DataFrame:
    """What changed between two snapshots: (key, change: added, removed or changed) by one pass over the log."""
    key = order.column(F.col("key"))

    def state(seq: int) -> Column:
        return F.max(F.when(F.col("seq") <= seq, F.struct("seq", "op")))

    ends = as_of(log, newer).groupBy(key.alias("__k")).agg(F.max_by("key", "seq").alias("key"), state(older).alias("a"), state(newer).alias("b"))
    had, has = F.coalesce(F.col("a.op") == PUT, F.lit(False)), F.coalesce(F.col("b.op") == PUT, F.lit(False))
    change = F.when(~had & has, "added").when(had & ~has, "removed").when(had & has & (F.col("a.seq") < F.col("b.seq")), "changed")
    return ends.select("key", change.alias("change")).where("change is not null")
