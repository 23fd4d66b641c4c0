"""Text queries with weighted terms, phrases within a slop and a minimum match, over postings with positions.

A query's distinct terms weigh by their idf as a share of all; each two that follow each other are a phrase of twice the larger weight. A
phrase occurs where its right term stands behind the left one with at most ``slop`` words between, or right before it, which
costs two; an occurrence counts 1 / (1 + distance), the nearest one for each place of the left term. Neighbours are found by an
equi-join on document and position, so no two documents meet and no list of positions is gathered.

Terms that more than ``common`` of all documents hold ask for nothing. A document must hold the ``least`` share of a query's terms, one
at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lantern.functions import text as T
from lantern.operators.lexical import by_id
from lantern.operators.matching import matches
from lantern.sources.shared import written


def positions(docs: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, pos, term), positions from 0."""
    return docs.select(id, F.posexplode(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "term"))


def built(queries: DataFrame, placed: DataFrame, total: DataFrame, qid: str, id: str, common: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(terms, phrases): terms is qid, term, weight, n (terms of the query); phrases is qid, left, right, boost.

    placed: documents' positions of at least the queries' terms. total: one row with the number of documents, ``docs``.
    """
    asked = positions(queries, qid).groupBy(qid, "term").agg(F.min("pos").alias("first"))
    df = placed.groupBy("term").agg(F.count_distinct(id).alias("df")).join(F.broadcast(total)).where(F.col("df") <= common * F.col("docs"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(df.select("term", idf.alias("idf")), "term")
    of = Window.partitionBy(qid)
    weighed = known.select(qid, "term", "first", F.round(F.col("idf") / F.sum("idf").over(of), 4).alias("weight"), F.count("*").over(of).alias("n"))
    follows = Window.partitionBy(qid).orderBy("first")
    pairs = weighed.withColumn("right", F.lead("term").over(follows)).withColumn("other", F.lead("weight").over(follows)).where("right is not null")
    return weighed.select(qid, "term", "weight", "n"), pairs.select(qid, F.col("term").alias("left"), "right", (2 * F.greatest("weight", "other")).alias("boost"))


def near(placed: DataFrame, pairs: DataFrame, id: str, slop: int) -> DataFrame:
    """(left, right, id, freq) for distinct pairs of terms (left, right) in a document."""
    offsets = [*range(1, slop + 2), *range(-1, -slop, -1)]
    target = F.explode(F.array(*(F.struct((F.col("pos") + o).alias("to"), F.lit(o - 1 if o > 0 else 1 - o).alias("distance")) for o in offsets)))
    lefts = placed.join(pairs.select(F.col("left").alias("term")).distinct(), "term", "left_semi").select(id, F.col("term").alias("left"), "pos", target.alias("at"))
    rights = placed.select(id, F.col("pos").alias("to"), F.col("term").alias("right"))
    met = lefts.select(id, "left", "pos", "at.to", "at.distance").join(rights, [id, "to"]).join(pairs, ["left", "right"], "left_semi")
    nearest = met.groupBy("left", "right", id, "pos").agg(F.min("distance").alias("distance"))
    return nearest.groupBy("left", "right", id).agg(F.sum(1 / (1 + F.col("distance"))).alias("freq"))


def search(queries: DataFrame, docs: DataFrame, qid: str, id: str, k: int = 10, slop: int = 2, least: float = 0.3, common: float = 0.25) -> DataFrame:
    """(qid, rank, id, score, terms, phrases): the k best documents, with how many terms and phrases of the query they hold."""
    vocabulary = positions(queries, qid).select("term").distinct()
    placed = written(positions(docs, id).join(F.broadcast(vocabulary), "term", "left_semi"), "positions")
    terms, phrases = built(queries, placed, docs.agg(F.count("*").alias("docs")), qid, id, common)
    terms, phrases = written(terms, "terms"), written(phrases, "phrases")
    saturated = lambda w, f: F.col(w) * F.col(f) / (F.col(f) + 1)
    single, several = by_id(docs.select(id, T.tokens(F.coalesce(F.col("text"), F.lit(""))).alias("tokens")), id)
    asked = terms.withColumn("least", F.greatest(F.lit(1), F.floor(F.col("n") * least)))
    found = matches(single, asked, id, qid, lambda tf, n: tf / (tf + 1)).select(qid, id, F.col("shared").alias("terms"), F.col("score").alias("by_term"))
    if several is not None:
        held = several.select(id, F.explode("tokens").alias("term")).groupBy(id, "term").agg(F.count("*").alias("tf")).join(asked, "term")
        more = held.groupBy(qid, id, "least").agg(F.count("*").alias("terms"), F.sum(saturated("weight", "tf")).alias("by_term")).where("terms >= least")
        found = found.unionByName(more.select(qid, id, "terms", "by_term"))
    close = near(placed, phrases.select("left", "right").distinct(), id, slop).join(phrases, ["left", "right"])
    close = close.groupBy(qid, id).agg(F.count("*").alias("phrases"), F.sum(saturated("boost", "freq")).alias("by_phrase"))
    score = F.round(F.col("by_term") + F.coalesce("by_phrase", F.lit(0.0)), 6)
    scored = found.join(close, [qid, id], "left").select(qid, id, score.alias("score"), "terms", F.coalesce("phrases", F.lit(0)).alias("phrases"))
    best = Window.partitionBy(qid).orderBy(F.col("score").desc(), id)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(qid, "rank", id, "score", "terms", "phrases")
