"""Periods of a subject: their union, gaps, tenures, first and last records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def islands(periods: DataFrame, by: str, start: str, end: str, now: Column) -> DataFrame:
    """(by, start, end, n): periods that overlap or touch as one. An open end is ``now``; a null start or an end before its start drops a period."""
    p = periods.select(by, F.col(start).alias("start"), F.coalesce(F.col(end), now).alias("end")).where("start is not null and end >= start")
    order = Window.partitionBy(by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("fresh", F.coalesce((F.col("start") > before), F.lit(True)).cast("int"))
    p = p.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def tenure(periods: DataFrame, by: str, start: str, end: str, now: Column, label: str) -> DataFrame:
    """By subject: jobs, mean and current tenure in days, days covered, the longest gap, labels of the first and the last job."""
    gap = F.date_diff("start", F.lag("end").over(Window.partitionBy(by).orderBy("start")))
    whole = islands(periods, by, start, end, now).withColumn("gap", gap)
    whole = whole.groupBy(by).agg(F.sum(F.date_diff("end", "start")).alias("covered_days"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), F.count("*").alias("islands"))
    p = periods.where(F.col(start).isNotNull() & (F.coalesce(F.col(end), now) >= F.col(start)))
    days = F.date_diff(F.coalesce(F.col(end), now), F.col(start))
    jobs = p.groupBy(by).agg(
        F.count("*").alias("jobs"), F.round(F.avg(days), 6).alias("mean_days"), F.max(F.when(F.col(end).isNull(), days)).alias("current_days"),
        F.min_by(label, F.struct(start, label)).alias("first"), F.max_by(label, F.struct(start, label)).alias("last"),
    )
    return jobs.join(whole, by)
