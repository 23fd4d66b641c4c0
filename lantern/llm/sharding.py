"""Sharding by global byte-size prefix sums. DataFrame functions only.

Rows are dealt to partitions by ranges of ``order``; each partition's total gives the sum before it, and a running sum inside
gives each row's place. The row whose middle lies in the i-th of n equal parts of all bytes goes to shard i: shards are
contiguous, and their sizes differ from the mean by one row at most.

A null text has no bytes, a null in ``order`` comes first, equal rows keep any order among themselves. Ranges are cut by
``order`` and then by the size, so that rows of one hot key needn't meet unless they are equal in both. Extra columns are kept and
may have any names but shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lantern.llm.common import packed, stored, unpacked

LAW = "bytes"


def shard(docs: DataFrame, n: int = 24, size: str = "size", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard). ``size`` is a column of positive numbers."""
    rows = packed(docs, size=F.col(size).cast("long"), **{f"k{i}": F.col(c) for i, c in enumerate(order)})
    keys = [F.col(f"k{i}").asc_nulls_first() for i in range(len(order))]
    dealt = stored(rows.repartitionByRange(*keys, F.col("size")).withColumn("part", F.spark_partition_id()), "ranges")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"))
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(every), F.lit(0)).alias("before"), F.sum("bytes").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("part").orderBy(*keys, "size")
    upto = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.join(totals, "part").withColumn("upto", upto).withColumn("place", F.row_number().over(inside))
    # twice the middle of the row, in whole numbers
    middle = (2 * F.col("upto") - F.col("size")).cast("decimal(38,0)")
    placed = placed.withColumn("shard", F.least(F.floor(middle * n / (2 * F.col("all"))), F.lit(n - 1)).cast("int"))
    # a shard's rows before this partition
    held = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    sooner = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("shard", "part", (F.coalesce(F.sum("rows").over(sooner), F.lit(0)) - F.col("first")).alias("shift"))
    out = placed.join(held, ["shard", "part"])
    return unpacked(out, docs, shard=F.col("shard"), slot=(F.col("place") + F.col("shift")).cast("long"))
