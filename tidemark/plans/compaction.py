"""Which rows compaction keeps, and how levels are chosen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.files import locate
from tidemark.schema import BYTEWISE, DEL, N_LEVELS, KeyOrder


def gc(log: DataFrame, floor: int, base_level: Column | bool = True, order: KeyOrder = BYTEWISE) -> DataFrame:
    """The rows that some snapshot at or above ``floor`` can still see.

    A row goes if the next newer row of its key, kept or not, is at or below the
    floor; a tombstone at or below the floor goes where no deeper level can hold
    its key (``base_level``). States at or above the floor don't change.
    """
    base = F.lit(base_level) if isinstance(base_level, bool) else base_level
    newer = F.lag("seq").over(Window.partitionBy(order.column(F.col("key"))).orderBy(F.desc("seq")))
    shadowed = F.coalesce(newer <= floor, F.lit(False))
    spent = (F.col("op") == DEL) & (F.col("seq") <= floor) & base
    return log.withColumn("__gone", shadowed | spent).where("NOT __gone").drop("__gone")


def with_base_level(log: DataFrame, deeper: DataFrame, order: KeyOrder = BYTEWISE) -> DataFrame:
    """Adds ``base_level``: no range of ``deeper`` (smallest, largest) covers the key.

    ``deeper`` is file metadata. Its ranges are merged into disjoint ones, which
    are searched where the keys are.
    """
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    ranges = sorted((plain(r["smallest"]), plain(r["largest"])) for r in merge_ranges(deeper).collect())
    found = locate(log, order.column(F.col("key")), [(lo, hi, 1) for lo, hi in ranges], "__deeper", "int")
    return found.withColumn("base_level", F.col("__deeper").isNull()).drop("__deeper")


def merge_ranges(files: DataFrame) -> DataFrame:
    """Overlapping (smallest, largest) ranges joined; a metadata-sized table."""
    order = Window.orderBy("smallest", "largest")
    reach = F.max("largest").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = files.select("smallest", "largest").withColumn("__new", F.when(reach >= F.col("smallest"), 0).otherwise(1))
    grouped = marked.withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("__group").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest")).drop("__group")


@dataclass(frozen=True)
class LevelPolicy:
    """When a level is full: level 0 by files, deeper ones by bytes that grow tenfold."""

    level0_files: int = 4
    base_bytes: int = 10 << 20
    growth: int = 10

    def limit(self, level: int) -> float:
        return float(self.level0_files) if level == 0 else float(self.base_bytes * self.growth ** (level - 1))

    def scores(self, files: DataFrame) -> DataFrame:
        """(level, files, bytes, score); a score of 1 or more is due. The last level is never due."""
        level = F.col("level")
        limit = self.base_bytes * F.pow(F.lit(float(self.growth)), level - 1)
        score = F.when(level == 0, F.col("files") / self.level0_files).when(level < N_LEVELS - 1, F.col("bytes") / limit).otherwise(0.0)
        return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).withColumn("score", score.cast("double"))

    def pick(self, stats: list[tuple[int, int, int]]) -> int | None:
        """The level with the highest due score of (level, files, bytes), the shallower on a tie."""
        scored = [((n / self.limit(0)) if level == 0 else size / self.limit(level), -level) for level, n, size in stats if level < N_LEVELS - 1]
        best = max(scored, default=(0.0, 0))
        return -best[1] if best[0] >= 1 else None
