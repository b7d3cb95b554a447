"""Bucketed histogram of latencies with interpolated percentiles."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _limits() -> list[float]:
    """Upper bounds (fixed values): 1 to 10 by one, then steps that keep two digits, up to 10^10 and beyond."""
    steps = [1.2, 1.4, 1.6, 1.8, 2, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 8, 9, 10]
    out = [float(i) for i in range(1, 11)]
    for power in range(1, 10):
        out += [round(s * 10**power) for s in steps]
    return [float(x) for x in out[:153]] + [1e200]


LIMITS = _limits()


@dataclass
class Histogram:
    """Counts values by bucket; ``merge`` adds another histogram."""

    counts: list[int] = field(default_factory=lambda: [0] * len(LIMITS))
    n: int = 0
    total: float = 0.0
    squares: float = 0.0
    least: float = math.inf
    most: float = -math.inf

    def add(self, x: float) -> None:
        self.counts[min(bisect_right(LIMITS, x), len(LIMITS) - 1)] += 1
        self.n, self.total, self.squares = self.n + 1, self.total + x, self.squares + x * x
        self.least, self.most = min(self.least, x), max(self.most, x)

    def merge(self, other: Histogram) -> None:
        self.counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        self.n, self.total, self.squares = self.n + other.n, self.total + other.total, self.squares + other.squares
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)

    @property
    def average(self) -> float:
        return self.total / self.n if self.n else 0.0

    @property
    def deviation(self) -> float:
        return math.sqrt(max(0.0, self.squares / self.n - self.average**2)) if self.n else 0.0

    def percentile(self, p: float) -> float:
        """The value below which ``p`` percent lie, interpolated within its bucket."""
        if not self.n:
            return 0.0
        want, seen = self.n * p / 100, 0
        for i, c in enumerate(self.counts):
            if c and seen + c >= want:
                lo = LIMITS[i - 1] if i else 0.0
                x = lo + (LIMITS[i] - lo) * (want - seen) / c
                return min(self.most, max(self.least, x))
            seen += c
        return self.most

    def __str__(self) -> str:
        if not self.n:
            return "Count: 0"
        return f"Count: {self.n}  Average: {self.average:.4f}  StdDev: {self.deviation:.2f}\nMin: {self.least:.4f}  Median: {self.percentile(50):.4f}  Max: {self.most:.4f}"


def bucket_of(x: Column) -> Column:
    """The bucket of a value: how many limits are not above it, by binary search."""
    table = F.array(*[F.lit(v) for v in LIMITS])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(LIMITS).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(LIMITS)) & (F.get(table, at + s - 1) <= x), at + s).otherwise(at))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bucket, lower, upper, n, share) of the buckets that aren't empty: 154 rows at most."""
    table = F.array(*[F.lit(v) for v in LIMITS])
    got = df.groupBy(bucket_of(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    return got.select(
        F.col("bucket").cast("long").alias("bucket"),
        F.when(F.col("bucket") == 0, 0.0).otherwise(F.get(table, F.col("bucket") - 1)).alias("lower"),
        F.get(table, F.col("bucket")).alias("upper"),
        "n",
        (F.col("n") / F.sum("n").over(every)).alias("share"),
    )


def summary(df: DataFrame, column: str, percents: tuple[float, ...] = (50.0, 90.0, 99.0)) -> DataFrame:
    """(n, average, deviation, least, most, p50, ...): percentiles interpolated within buckets, one row."""
    x = F.col(column)
    stats = df.agg(F.count(x).alias("n"), F.avg(x).alias("average"), F.stddev_pop(x).alias("deviation"), F.min(x).alias("least"), F.max(x).alias("most"))
    buckets = histogram(df, column)
    order = Window.orderBy("bucket")
    seen = buckets.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    parts = []
    for p in percents:
        want = F.col("total") * p / 100
        hit = (F.col("upto") >= want) & (F.col("upto") - F.col("n") < want)
        parts.append(F.max(F.when(hit, F.col("lower") + (F.col("upper") - F.col("lower")) * (want - (F.col("upto") - F.col("n"))) / F.col("n"))).alias(f"p{p:g}"))
    return stats.join(seen.agg(*parts).withColumn("__one", F.lit(1)), F.lit(1) == F.col("__one")).select(
        "n", "average", "deviation", "least", "most", *[F.least("most", F.greatest("least", f"p{p:g}")).alias(f"p{p:g}") for p in percents]
    )
