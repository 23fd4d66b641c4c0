"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _share(condition: Column) -> Column:
    return F.round(F.coalesce(F.avg(condition.cast("double")), F.lit(0.0)), 6)


def retrieval(results: DataFrame, kind: str, rank: str = "rank", k: int = 5) -> DataFrame:
    """results: a row for each case with the rank of the first right document, null for a miss. One row overall (kind null), one
    for each kind."""
    hit = lambda n: F.coalesce(F.col(rank) <= n, F.lit(False))
    mrr = F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), F.lit(0.0)), 6)
    return results.groupingSets([[], [kind]], kind).agg(F.count("*").alias("cases"), _share(hit(1)).alias("hit_1"), _share(hit(3)).alias("hit_3"), _share(hit(k)).alias("hit_k"), mrr.alias("mrr"))


def percentile(df: DataFrame, by: str, value: str, share: float, buckets: int = 4096, levels: int = 2) -> DataFrame:
    """The value at place round_half_even((n - 1) * share) of each group's sorted values: (by, n, percentile).

    No group is sorted as a whole: its range is cut into buckets, their counts show in which one the place lies, and that one is cut
    again; only the values of the last, very narrow bucket are put in order.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    state = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = state.withColumn("left", F.rint((F.col("n") - 1) * share))  # values before the place, in the range
    inside = lambda s: v.withColumnRenamed("g", "of").join(F.broadcast(s), F.col("of").eqNullSafe(F.col("g")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    for _ in range(levels):
        width = (F.col("hi") - F.col("lo")) / buckets
        bucket = F.when(width > 0, F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise(0)
        sums = inside(state).groupBy("g", "n", "left", bucket.alias("bucket")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("g").orderBy("bucket"))  # at most ``buckets`` rows of a group
        edge = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left")).groupBy("g", "n", "left").agg(F.min_by(F.struct("lo", "hi", (F.col("upto") - F.col("c")).alias("before")), "bucket").alias("e"))
        state = edge.select("g", "n", "e.lo", "e.hi", (F.col("left") - F.col("e.before")).alias("left"))
    counts = inside(state).groupBy("g", "n", "left", "v").agg(F.count("*").alias("c"))
    placed = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("g").orderBy("v"))).where(F.col("upto") > F.col("left"))
    return placed.groupBy("g", "n").agg(F.min("v").alias("percentile")).select(F.col("g").alias(by), "n", "percentile")


def delta(current: DataFrame, baseline: DataFrame, by: str, names: list[str]) -> DataFrame:
    """(by, metric, current, baseline, delta, relative); relative is 0 where the baseline is 0, a missing value counts as 0."""
    long = lambda df, v: df.unpivot([by], names, "metric", v)
    both = long(current, "current").join(long(baseline, "baseline"), [by, "metric"], "full")
    a, b = F.coalesce("current", F.lit(0.0)), F.coalesce("baseline", F.lit(0.0))
    relative = F.when(b == 0, 0.0).otherwise((a - b) / b)
    return both.select(by, "metric", a.alias("current"), b.alias("baseline"), F.round(a - b, 6).alias("delta"), F.round(relative, 6).alias("relative"))
