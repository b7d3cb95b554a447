"""Ordered access to a state: ends, seeks, neighbours, ranges and pages.

``None`` as a bound means none; an empty key is a bound like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import BYTEWISE, KeyOrder


def in_order(state: DataFrame, order: KeyOrder = BYTEWISE, reverse: bool = False) -> DataFrame:
    key = order.column(F.col("key"))
    return state.orderBy(key.desc() if reverse else key.asc())


def first(state: DataFrame, order: KeyOrder = BYTEWISE) -> DataFrame:
    return in_order(state, order).limit(1)


def last(state: DataFrame, order: KeyOrder = BYTEWISE) -> DataFrame:
    return in_order(state, order, reverse=True).limit(1)


def seek(state: DataFrame, target: object, order: KeyOrder = BYTEWISE) -> DataFrame:
    """The first row at or after ``target``."""
    return first(key_range(state, target, None, order), order)


def seek_before(state: DataFrame, target: object, order: KeyOrder = BYTEWISE) -> DataFrame:
    """The last row before ``target``."""
    return last(key_range(state, None, target, order), order)


def key_range(state: DataFrame, start: object | None, limit: object | None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """Rows with start <= key < limit."""
    key = order.column(F.col("key"))
    if start is not None:
        state = state.where(key >= F.lit(order.value(start)))
    if limit is not None:
        state = state.where(key < F.lit(order.value(limit)))
    return state


def page(state: DataFrame, after: object | None, n: int, order: KeyOrder = BYTEWISE, reverse: bool = False) -> DataFrame:
    """The next ``n`` rows after the key ``after`` (from an end for None), by a bound and a top-n."""
    key = order.column(F.col("key"))
    if after is not None:
        bound = F.lit(order.value(after))
        state = state.where(key < bound if reverse else key > bound)
    return in_order(state, order, reverse).limit(n)


def split_by_keys(state: DataFrame, ranges: int, order: KeyOrder = BYTEWISE, name: str = "__part") -> DataFrame:
    """Adds the number of the key range of each row. Bounds are the keys of least hash: a fixed sample of ``ranges`` - 1 keys."""
    key = order.column(F.col("key"))
    sample = state.select(key.alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(ranges - 1)
    bounds = sorted(r["k"] for r in sample.collect())
    if not bounds:
        return state.withColumn(name, F.lit(0))
    table = F.array(*[F.lit(b) for b in bounds])
    return state.withColumn(name, F.size(F.filter(table, lambda b: b <= key)))


def neighbours(state: DataFrame, ranges: int = 64, order: KeyOrder = BYTEWISE) -> DataFrame:
    """Adds prev_key and next_key.

    Rows are compared within key ranges, so no task holds the whole state; the
    rows at the ends of ranges look into a table with a row for each range.
    """
    placed = split_by_keys(state.withColumn("__k", order.column(F.col("key"))), ranges, order)
    within = Window.partitionBy("__part").orderBy("__k")
    ends = placed.groupBy("__part").agg(F.min_by("key", "__k").alias("__first"), F.max_by("key", "__k").alias("__last"))
    along = Window.orderBy("__part")
    ends = ends.select(F.col("__part").alias("__p"), F.lag("__last").over(along).alias("__before"), F.lead("__first").over(along).alias("__after"))
    joined = placed.join(F.broadcast(ends), F.col("__part") == F.col("__p"))
    return joined.withColumns(
        {"prev_key": F.coalesce(F.lag("key").over(within), "__before"), "next_key": F.coalesce(F.lead("key").over(within), "__after")}
    ).drop("__k", "__part", "__p", "__before", "__after")
