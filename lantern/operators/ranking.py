"""Operators on ranked lists: fusion, merging, diversity, de-duplication.

A list is rows (query, key, ...) with a position; every order ends in the key, so results don't depend on the rows' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(df: DataFrame, query: str, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def rrf(lists: DataFrame, query: str, key: str, rank: str, k: int = 60, weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of all lists of a query: (query, key, score, appearances, best_rank)."""
    return lists.groupBy(query, key).agg(F.round(F.sum(weight / (k + F.col(rank))), 6).alias("score"), F.count("*").alias("appearances"), F.min(rank).alias("best_rank"))


def weighted(left: DataFrame, right: DataFrame, query: str, key: str, a: str, b: str, w: float) -> DataFrame:
    """(1 - w) times left's score plus w times right's, 0 where a list lacks the key."""
    both = left.select(query, key, a).join(right.select(query, key, b), [query, key], "full")
    return both.select(query, key, F.round((1 - w) * F.coalesce(a, F.lit(0.0)) + w * F.coalesce(b, F.lit(0.0)), 6).alias("score"))


def round_robin(df: DataFrame, query: str, doc: str, pos: str, most: int | None = 2) -> DataFrame:
    """The first of each document in the order in which documents come, then the second of each; what is beyond ``most`` of a
    document follows in its old order. Adds ``place``."""
    by_doc = Window.partitionBy(query, doc)
    d = df.withColumn("depth", F.row_number().over(by_doc.orderBy(pos))).withColumn("first", F.min(pos).over(by_doc))
    late = F.lit(False) if most is None else F.col("depth") > most
    order = Window.partitionBy(query).orderBy(late, F.when(late, F.col(pos)).otherwise(F.col("depth")), F.when(late, 0).otherwise(F.col("first")), pos, doc)
    return d.withColumn("place", F.row_number().over(order)).drop("depth", "first")


def distinct_docs_first(df: DataFrame, query: str, doc: str, pos: str, n: int) -> DataFrame:
    """The first rows of the first n documents, then all others in their old order. Adds ``place``."""
    lead = F.row_number().over(Window.partitionBy(query, doc).orderBy(pos)) == 1
    d = df.withColumn("lead", lead.cast("int"))
    nth = F.sum("lead").over(Window.partitionBy(query).orderBy(pos, doc).rowsBetween(Window.unboundedPreceding, 0))
    picked = (F.col("lead") == 1) & (F.col("nth") <= n)
    d = d.withColumn("nth", nth)
    return d.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.when(picked, 0).otherwise(1), pos, doc))).drop("lead", "nth")


def keep_first(df: DataFrame, query: str, key: Column, *order: Column) -> DataFrame:
    """The first row of each key, ranked anew as ``rank``."""
    d = df.withColumn("_key", key)
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(query, "_key").orderBy(*order))).where("_n = 1").drop("_n", "_key", "rank")
    return ranked(d, query, *order)


def prepend(first: DataFrame, then: DataFrame, query: str, key: str, pos: str, n: int) -> DataFrame:
    """All of ``first``, then those of ``then`` with new keys; n of each query. (query, key, place)."""
    both = first.select(query, key, pos).withColumn("list", F.lit(0)).unionByName(then.select(query, key, pos).withColumn("list", F.lit(1)))
    one = both.groupBy(query, key).agg(F.min(F.struct("list", pos)).alias("at"))
    return ranked(one, query, F.col("at.list"), F.col(f"at.{pos}"), F.col(key), name="place").where(F.col("place") <= n).select(query, key, "place")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
