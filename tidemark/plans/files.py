"""Plans over file metadata: (number, level, smallest, largest, bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import N_LEVELS

#: Ranges that a plan holds as literals.
LITERALS = 4096


def describe(log: DataFrame, file: Column, level: Column, size: Column) -> DataFrame:
    """Metadata of the files into which ``file`` deals the rows of a log."""
    return log.groupBy(file.alias("number"), level.alias("level")).agg(
        F.min("key").alias("smallest"), F.max("key").alias("largest"), F.sum(size).alias("bytes"), F.count("*").alias("entries"), F.max("seq").alias("max_seq")
    )


def overlapping(files: DataFrame, lo: object | None, hi: object | None) -> DataFrame:
    """Files whose key range meets [lo, hi]; None is unbounded."""
    if lo is not None:
        files = files.where(F.col("largest") >= F.lit(lo))
    if hi is not None:
        files = files.where(F.col("smallest") <= F.lit(hi))
    return files


def find_file(files: DataFrame, key: object) -> DataFrame:
    """(position): how many files of a disjoint level end before ``key``."""
    return files.agg(F.count(F.when(F.col("largest") < F.lit(key), 1)).alias("position"))


def lower_bound(table: Column, key: Column, steps: int) -> Column:
    """How many entries of an ascending array are below ``key`` (null for none), by binary search; it has fewer than 2^``steps``."""
    widths = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    search = F.aggregate(widths, F.lit(0), lambda at, w: F.when((at + w <= F.size(table)) & (F.get(table, at + w - 1) < key), at + w).otherwise(at))
    return F.when(key.isNotNull(), search)


def locate(rows: DataFrame, key: Column, ranges: list[tuple[object, object, object]], name: str, kind: str) -> DataFrame:
    """``rows`` with ``name``: the value of the range (smallest, largest, value) that holds ``key``, null for none.

    ``ranges`` are sorted and disjoint, one for each file. Up to ``LITERALS`` of
    them are arrays in the plan; more are a table of so many groups, joined by
    the group's number, so neither the plan nor a row's share of it grows.
    """
    if not ranges:
        return rows.withColumn(name, F.lit(None).cast(kind))
    per = -(-len(ranges) // LITERALS)
    groups = [ranges[i : i + per] for i in range(0, len(ranges), per)]
    at = lower_bound(F.array(*[F.lit(g[-1][1]) for g in groups]), key, len(groups).bit_length())
    placed = rows.withColumn("__at", at)
    if per == 1:
        lows, values = (F.array(*[F.lit(g[0][i]) for g in groups]) for i in (0, 2))
        return placed.withColumn(name, F.when(F.get(lows, F.col("__at")) <= key, F.get(values, F.col("__at"))).cast(kind)).drop("__at")
    of = {bytes: "binary", str: "string", int: "bigint"}
    columns = ", ".join(f"__r{i} array<{of[type(ranges[0][i])]}>" for i in range(3))
    table = rows.sparkSession.createDataFrame([(n, *[[r[i] for r in g] for i in range(3)]) for n, g in enumerate(groups)], f"__group int, {columns}")
    joined = placed.join(table, F.col("__at") == F.col("__group"), "left").withColumn("__in", lower_bound(F.col("__r1"), key, per.bit_length()))
    found = F.when(F.get(F.col("__r0"), F.col("__in")) <= key, F.get(F.col("__r2"), F.col("__in")))
    return joined.withColumn(name, found.cast(kind)).drop("__at", "__group", "__r0", "__r1", "__r2", "__in")


def find_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key with the number of the file of a disjoint level that may hold it (null: none)."""
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    rows = sorted((plain(r["smallest"]), plain(r["largest"]), r["number"]) for r in files.select("smallest", "largest", "number").collect())
    return locate(keys.select("key"), F.col("key"), rows, "number", files.schema["number"].dataType.simpleString())


def apart(files: list, extra: tuple[object, object] | None = None) -> tuple[list, list]:
    """(files whose key range meets no other file's and not ``extra``, the others), each in order of keys."""
    ranked = sorted(files, key=lambda f: (f.smallest, f.largest))
    alone, others, reach = [], [], None
    for i, f in enumerate(ranked):
        after = ranked[i + 1].smallest if i + 1 < len(ranked) else None
        meets = (reach is not None and f.smallest <= reach) or (after is not None and after <= f.largest) or (extra is not None and f.smallest <= extra[1] and extra[0] <= f.largest)
        (others if meets else alone).append(f)
        reach = f.largest if reach is None else max(reach, f.largest)
    return alone, others


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def next_level_overlap(files: DataFrame) -> DataFrame:
    """(max_overlap): the most bytes of the next level that one file of levels 1 and deeper meets.

    Files of a level are disjoint, so what a file meets is a difference of two
    running sums over the next level: bytes that start at or before its end
    less bytes that end before its start.
    """
    mine = files.where((F.col("level") >= 1) & (F.col("level") < N_LEVELS - 1))
    next_level = files.where(F.col("level") >= 2).withColumn("level", F.col("level") - 1)
    zero = F.lit(0).cast("long")
    points = (
        next_level.select("level", F.col("smallest").alias("at"), F.lit(0).alias("kind"), F.col("bytes").alias("begun"), zero.alias("ended"), F.lit(None).cast("long").alias("number"))
        .unionByName(next_level.select("level", F.col("largest").alias("at"), F.lit(2).alias("kind"), zero.alias("begun"), F.col("bytes").alias("ended"), F.lit(None).cast("long").alias("number")))
        .unionByName(mine.select("level", F.col("smallest").alias("at"), F.lit(1).alias("kind"), zero.alias("begun"), zero.alias("ended"), F.col("number").cast("long")))
        .unionByName(mine.select("level", F.col("largest").alias("at"), F.lit(1).alias("kind"), zero.alias("begun"), zero.alias("ended"), F.col("number").cast("long")))
    )
    so_far = Window.partitionBy("level").orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = points.withColumns({"b": F.sum("begun").over(so_far), "e": F.sum("ended").over(so_far)}).where("number is not null")
    return sums.groupBy("level", "number").agg((F.max("b") - F.min("e")).alias("meets")).agg(F.coalesce(F.max("meets"), F.lit(0)).alias("max_overlap"))


def closure(files: list[dict], lo: object | None, hi: object | None, grow: bool) -> list[dict]:
    """Files that meet [lo, hi]; with ``grow`` (level 0) the range grows to each file found until none is new."""
    while True:
        found = [f for f in files if (lo is None or f["largest"] >= lo) and (hi is None or f["smallest"] <= hi)]
        if not grow or not found:
            return found
        low = lo if lo is None else min(lo, *(f["smallest"] for f in found))
        high = hi if hi is None else max(hi, *(f["largest"] for f in found))
        if (low, high) == (lo, hi):
            return found
        lo, hi = low, high


def approximate_sizes(rows: DataFrame, ranges: list[tuple[object, object]], size: Column) -> DataFrame:
    """(start, limit, bytes): the bytes of rows with start <= key < limit, all ranges in one pass."""
    sums = rows.agg(*[F.coalesce(F.sum(F.when((F.col("key") >= F.lit(a)) & (F.col("key") < F.lit(b)), size)), F.lit(0)).alias(f"r{i}") for i, (a, b) in enumerate(ranges)])
    table = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("limit"), F.col(f"r{i}").alias("bytes")) for i, (a, b) in enumerate(ranges)])
    return sums.select(F.explode(table).alias("r")).select("r.*")


def cut_points(sizes: list[int], overlaps: list[int], max_bytes: int, max_overlap: int) -> list[int]:
    """Where output files end: at ``max_bytes``, or before the overlap with the level after next exceeds ``max_overlap``."""
    ends, size, met = [], 0, 0
    for i, (s, o) in enumerate(zip(sizes, overlaps, strict=True)):
        if size and (met + o > max_overlap or size >= max_bytes):
            ends.append(i)
            size = met = 0
        size, met = size + s, met + o
    return [*ends, len(sizes)] if sizes else []
