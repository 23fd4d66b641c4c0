"""Re-ranking and fusion of candidates by weighted evidence, and relaxed second searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.sources.shared import written

#: Fixed values of the fusion over several queries: what a rank, a lexical score, a vector score and a similarity weigh.
RANK_WEIGHT, LEXICAL_WEIGHT, VECTOR_WEIGHT, SIMILARITY_WEIGHT, RANK_OFFSET = 1.2, 0.75, 0.20, 0.05, 60

#: Rows that are sorted in one task.
RANGE = 1_000_000


def token_similarity(query: Column, doc: Column, weight=lambda t: F.lit(1.0)) -> Column:
    """Weight of the query's tokens that the document has over the weight of all, smoothed by 1e-9."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, t: acc + weight(t))
    return (total(F.array_intersect(query, doc)) + 1e-9) / (total(F.array_distinct(query)) + 1e-9)


def token_overlap(query: Column, doc: Column) -> Column:
    return F.size(F.array_intersect(query, doc)) / (F.size(F.array_distinct(query)) + 1e-6)


def fuse_queries(lists: DataFrame, query: str, key: str, rank: str, lexical: str, vector: str, similarity: str) -> DataFrame:
    """One row for each query and key: summed fusion, appearances, best rank, best similarity."""
    part = RANK_WEIGHT / (RANK_OFFSET + F.col(rank)) + LEXICAL_WEIGHT * F.col(lexical) + VECTOR_WEIGHT * F.col(vector) + SIMILARITY_WEIGHT * F.col(similarity)
    return lists.groupBy(query, key).agg(F.sum(part).alias("fusion"), F.count("*").alias("appearances"), F.min(rank).alias("best_rank"), F.max(similarity).alias("best_similarity"))


def relaxed(strict: DataFrame, loose: DataFrame, query: str) -> DataFrame:
    """Strict hits, and loose ones for the queries that have no strict hit."""
    return strict.unionByName(loose.join(strict.select(query).distinct(), query, "left_anti"))


def prefer(df: DataFrame, query: str, conflict: Column, matched: Column, *order: Column, name: str = "place") -> DataFrame:
    """Conflicting rows go unless all of a query's rows conflict; matched rows come first, else the order stays.

    All rows are sorted in ranges of about ``RANGE``, so that no query's rows need to meet in one task; a row's place is its number among all
    less that of its query's first one.
    """
    by = [F.col(query), F.col("_c"), F.coalesce(matched, F.lit(False)).desc(), *order]
    marked = written(df.withColumn("_c", F.coalesce(conflict, F.lit(False))), "marked")  # read twice, as ranges are cut by a sample
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), marked.count() // RANGE)
    # the number counts from 0 in each range, whose own number is in the upper bits
    dealt = written(marked.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_sooner"))
    firsts = dealt.groupBy(F.col(query).alias("_q")).agg(F.min("_at").alias("_at"), F.min("_c").alias("_all"))
    firsts = firsts.join(F.broadcast(ranges), part == F.col("_part")).select("_q", "_all", (F.col("_sooner") + inside).alias("_first"))
    placed = dealt.join(F.broadcast(ranges), part == F.col("_part")).join(firsts, F.col(query).eqNullSafe(F.col("_q"))).where(~F.col("_c") | F.col("_all"))
    return placed.withColumn(name, F.col("_sooner") + inside - F.col("_first") + 1).select(*df.columns, name)


def neighbours_boost(tokens: Column) -> Column:
    """Phrases of two adjacent tokens."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    return F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>"))
