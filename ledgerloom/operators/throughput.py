"""Throughput of overlapping intervals: a sweep over starts and ends as grouped sums and one running sum.

Times are dealt to ranges first: each range's own running sum starts from the sum of all earlier ranges, so no task
holds all times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

RETAINED_MS = 5 * 60 * 1000


def retained(intervals: DataFrame, now_ms: Column) -> DataFrame:
    """Intervals that end at most five minutes before now."""
    return intervals.where(F.col("start_ms") + F.col("duration_ms") >= now_ms - RETAINED_MS)


def timeline(intervals: DataFrame, metrics: list[str], bucket_ms: int = 3_600_000) -> DataFrame:
    """(time_ms, concurrency, <metric>..., next_ms) from (start_ms, duration_ms, <metric>...): concurrency and rates a
    second from each time on. Intervals under 1 ms are left out."""
    use = intervals.where("duration_ms >= 1")
    rates = [(F.col(m) * 1000 / F.col("duration_ms")).alias(m) for m in metrics]
    up = use.select(F.col("start_ms").alias("time_ms"), F.lit(1).cast("long").alias("concurrency"), *rates)
    down = use.select((F.col("start_ms") + F.col("duration_ms")).alias("time_ms"), F.lit(-1).cast("long").alias("concurrency"), *[(-r).alias(m) for r, m in zip(rates, metrics, strict=True)])
    parts = ["concurrency", *metrics]
    steps = stored(up.unionAll(down).groupBy("time_ms").agg(*[F.sum(c).alias(c) for c in parts]).withColumn("_b", F.floor(F.col("time_ms") / bucket_ms)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("_b").agg(*[F.sum(c).alias(c) for c in parts], F.min("time_ms").alias("_first"))
    sums = sums.select("_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in parts], F.lead("_first").over(Window.orderBy("_b")).alias("_next"))
    w = Window.partitionBy("_b").orderBy("time_ms")
    t = steps.join(sums, "_b")
    return t.select("time_ms", *[(F.sum(c).over(w) + F.col(f"_{c}")).alias(c) for c in parts], F.coalesce(F.lead("time_ms").over(w), F.col("_next")).alias("next_ms"))


def summary(intervals: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: intervals, active_ms (while any interval runs), average concurrency and duration, and each metric's total
    and average for an active second; averages are 0 without activity."""
    line = timeline(intervals, metrics).where("concurrency > 0").withColumn("ms", F.col("next_ms") - F.col("time_ms"))
    area = line.agg(F.coalesce(F.sum("ms"), F.lit(0)).alias("active_ms"), F.sum(F.col("concurrency") * F.col("ms")).alias("c"), *[F.sum(F.col(m) * F.col("ms")).alias(f"a_{m}") for m in metrics])
    use = intervals.where("duration_ms >= 1")
    total = use.agg(F.count(F.lit(1)).alias("intervals"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("average_duration_ms"), *[F.coalesce(F.sum(m), F.lit(0)).alias(f"total_{m}") for m in metrics])

    def mean(c: str) -> Column:
        return F.when(F.col("active_ms") > 0, F.col(c) / F.col("active_ms")).otherwise(F.lit(0.0))

    both = total.crossJoin(area)  # one row each
    return both.select("intervals", "active_ms", mean("c").alias("average_concurrency"), "average_duration_ms", *[x for m in metrics for x in (F.col(f"total_{m}"), mean(f"a_{m}").alias(f"{m}_per_active_second"))])
