"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule, a piecewise-linear function of training
time 0..1. Its integral is the source's weight; the targets share the budget
by weight, none above ``max_epochs`` times its source (water filling). Each
source's documents stand in a fixed pseudo-random order; the words before a
document are its cumulative demand, and inverting the integrated schedule at
that demand gives the document's training position. Sorting by position
interleaves the sources as the schedules ask.

Scale: a source may hold most rows, so running sums are two-level: sums per
(source, hash range) first, then within one hash range. No window holds a
whole source. Only the table of sources is handled in one task.

Defined cases: null or empty text has size 0; a null source is a source of its
own and comes last; an empty table gives no rows; repeated rows are rows of
their own; a source without words has target 0 and its documents are taken in
no epoch; extra columns pass through, and the operator's own names get
underscores in front where they clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, free_name, read_table, sealed

Knots = list[tuple[float, float]]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ramp(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating by rank; odd ranks fade out over the run, even ones fade in."""
    weight = (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")
    first = F.when(rank % 2 == 1, 1.5).otherwise(0.5) * weight
    last = F.when(rank % 2 == 1, 0.5).otherwise(1.5) * weight
    return knots_column([(F.lit(0.0), first), (F.lit(1.0), last)])


def knots_column(knots: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(t.cast("double").alias("t"), w.cast("double").alias("w")) for t, w in knots])


def integrate(knots: Column) -> Column:
    """Each segment with the integral before it: array of (a, t, w, slope), then the total."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(knots) - 2),
        lambda i: F.struct(
            F.get(knots, i)["t"].alias("t"),
            F.get(knots, i)["w"].alias("w"),
            (F.get(knots, i + 1)["t"] - F.get(knots, i)["t"]).alias("dt"),
            F.get(knots, i + 1)["w"].alias("w1"),
        ),
    )
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            F.aggregate(F.slice(pairs, F.lit(1), i), F.lit(0.0), lambda acc, q: acc + q["dt"] * (q["w"] + q["w1"]) / 2).alias("a"),
            p["t"].alias("t"),
            p["w"].alias("w"),
            F.when(p["dt"] > 0, (p["w1"] - p["w"]) / p["dt"]).otherwise(0.0).alias("slope"),
            (p["dt"] * (p["w"] + p["w1"]) / 2).alias("area"),
        ),
    )


def invert(segments: Column, weight: Column, share: Column) -> Column:
    """The time by which ``share`` (0..1) of the schedule's integral has passed."""
    want = share * weight
    seg = F.element_at(F.filter(segments, lambda s: (s["a"] <= want) & (s["area"] > 0)), -1)
    rest = want - seg["a"]
    root = F.sqrt(F.greatest(F.lit(0.0), seg["w"] * seg["w"] + 2 * seg["slope"] * rest))
    step = F.when(rest <= 0, 0.0).otherwise(2 * rest / (seg["w"] + root))
    return F.least(F.lit(1.0), F.coalesce(seg["t"] + step, F.lit(0.0)))


def targets(sizes: DataFrame, schedule: Callable[[Column], Column], budget_share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) -> + segments, weight, target. One small task: a row for each source."""
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("segments", integrate(schedule(F.col("rank"))))
    ranked = ranked.withColumn("weight", F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + s["area"]))
    ranked = ranked.withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    ranked = ranked.withColumn("budget", F.least(budget_share * F.sum("source_size").over(every).cast("double"), F.sum("cap").over(every)))
    # Sources fill up in the order of cap / weight; the first level that fits the next source holds for all after it.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))
    ranked = ranked.withColumn("final", F.min(fits).over(every)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return ranked.select("source", "source_size", "segments", "weight", target.alias("target"))


def plan_mix(
    docs: DataFrame,
    schedule: Callable[[Column], Column] = ramp,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_share: float = 1.0,
    max_epochs: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_positions.

    mix_positions has the training position (0..1) of the document in each epoch
    that takes it, first epoch first; empty if untaken. A document is taken in an
    epoch if its middle word lies within the epoch's part of the target.
    """
    docs, name, restore = sealed(docs)
    id_col, text_col, source_col = name(id_col), name(text_col), name(source_col)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    rows = docs.withColumns({"mix_key": key, "mix_size": word_count(F.col(text_col)), "mix_range": F.substring(key, 1, 3), "mix_source": source})
    ranges = cut(rows.groupBy(F.col(source_col).alias("source"), "mix_source", "mix_range").agg(F.sum("mix_size").alias("range_size")))
    by_source = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), schedule, budget_share, max_epochs)
    starts = ranges.withColumn(
        "range_start",
        F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    plan = starts.join(by_source.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).select(
        F.col("mix_source").alias("p_source"), F.col("mix_range").alias("p_range"), "range_start", "source_size", "target", "segments", "weight"
    )
    within = Window.partitionBy("mix_source", "mix_range").orderBy("mix_key", F.col(id_col), "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mix_before", F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    joined = rows.alias("r").join(plan, (F.col("mix_source") == F.col("p_source")) & (F.col("mix_range") == F.col("p_range")))
    middle = F.col("range_start") + F.col("mix_before") + F.col("mix_size") / 2
    epochs = F.filter(
        F.sequence(F.lit(0), F.ceil(F.lit(max_epochs)).cast("int") - 1),
        lambda k: (F.col("target") > 0) & (middle <= F.col("target") - k * F.col("source_size")),
    )
    position = F.transform(
        epochs, lambda k: invert(F.col("segments"), F.col("weight"), F.least(F.lit(1.0), (k * F.col("source_size") + middle) / F.col("target")))
    )
    mixed = joined.select(
        *[F.col(f"r.`{c}`") for c in docs.columns],
        "mix_size",
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        position.alias("mix_positions"),
    )
    return restore(mixed)


def mix(docs: DataFrame, schedule: Callable[[Column], Column] = ramp, **options) -> DataFrame:
    """The training set: a row of ``docs`` for each epoch that takes it, range-sorted by position."""
    planned = plan_mix(docs, schedule, **options)
    at = free_name(planned, "mix_position")
    return planned.withColumn(at, F.explode(planned.columns[-1])).orderBy(at).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, in training order (untaken ones last)."""
    planned = plan_mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    epochs = F.size("mix_positions").cast("long")
    return planned.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (epochs * F.col("mix_size")).alias("taken"),
        epochs.alias("epochs"),
        F.round(F.get("mix_positions", F.lit(0)), 9).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CAST((rk - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * CAST(source_size AS DOUBLE) AS cap,
             CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
f AS (SELECT *, (SELECT arg_min(lv, cap / weight) FROM l WHERE lv * weight <= cap) AS final FROM l),
t AS (SELECT *, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, t.rk,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(CASE WHEN target > 0 THEN CAST(middle <= target AS INT) + CAST(middle <= target - source_size AS INT) + CAST(middle <= target - 2 * source_size AS INT) ELSE 0 END AS BIGINT) AS epochs,
             least(1.0::DOUBLE, middle::DOUBLE / nullif(target, 0)) * weight AS want,
             (CASE WHEN rk % 2 = 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END) * weight AS w0,
             (CASE WHEN rk % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * weight AS slope FROM c)
SELECT doc_id, size, source_size, target, epochs * size AS taken, epochs,
       CASE WHEN epochs > 0 THEN round(least(1.0::DOUBLE, CASE WHEN want <= 0 THEN 0.0::DOUBLE ELSE 2 * want / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2 * slope * want))) END), 9) END AS position
FROM e
"""
