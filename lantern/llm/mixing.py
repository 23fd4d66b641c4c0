"""Mixing sources to target weights by hash thresholds. DataFrame functions only.

Each document has a hash of 40 bits. A source's target is so many whole copies of it, and for the rest the documents whose
hash lies below a threshold. Sizes are summed by source and the hash's leading 10 bits; the bucket in which the rest runs out
is refined by the next 10 bits, four times over, so no documents are sorted. What is taken differs from the target by half of
the size of the documents that share all 40 bits at the threshold.

A null source is a source, a null text has size 0. No document comes more than ``most`` times. A source without any words is
taken once. Documents with equal doc_id and size are taken or left together. Extra columns are kept by ``copies`` and may have any
names but those of its new columns (mix_size, mix_hash, mix_source_size, mix_target, mix_copies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lantern.llm.common import WORD, packed, stored, unpacked

BITS, LEVELS = 10, 4


def sized(docs: DataFrame) -> DataFrame:
    """Adds mix_size (words of the text) and mix_hash (40 bits)."""
    size = F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long")
    return docs.withColumn("mix_size", size).withColumn("mix_hash", F.shiftrightunsigned(F.xxhash64("doc_id", "mix_size"), 64 - BITS * LEVELS))


def targets(sizes: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources in the order of their code points, null last, weigh ``weights``, repeated. All sizes are shared by weight; no target
    is above ``most`` times its source's size, and what is above goes to the others by weight. Sources are a small table here.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    total = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("share", left / (F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).withColumn("full", F.col("share") >= F.col("ratio"))
    kept = F.sum("source_size").over(total) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(total)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(total)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", kept / free * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): copies of each document, and one more of those with mix_hash < below.

    sizes: (source, mix_size, mix_hash), a written table that is read once for each level.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")
    state = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("below", F.lit(0).cast("long"))
    full = state.where("rest <= 0").select("source", "source_size", "target", "whole", "below")  # no further copy of anything
    state = state.where("rest > 0")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        at = state.select(F.col("source").alias("s"), "rest", F.col("below").alias("prefix"))
        inside = sizes.join(at, sizes["source"].eqNullSafe(at["s"]) & (F.shiftright(sizes["mix_hash"], shift + BITS) == at["prefix"]))
        sums = inside.groupBy("source", F.shiftright("mix_hash", shift).alias("bucket")).agg(F.sum("mix_size").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        run = sums.withColumn("upto", upto).where("upto > rest")
        edge = run.groupBy(F.col("source").alias("s")).agg(F.min_by(F.struct("bucket", "n", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("e"))
        state = state.join(edge, state["source"].eqNullSafe(edge["s"]), "left")
        # no bucket runs over: all of this prefix is taken
        bucket = F.coalesce("e.bucket", F.shiftleft("below", BITS) + (1 << BITS) - 1)
        state = state.select("source", "source_size", "target", "whole", (F.col("rest") - F.coalesce("e.before", F.lit(0))).alias("rest"), bucket.alias("below"), F.coalesce("e.n", F.lit(0)).alias("n"))
        state = stored(state, f"mix{level}")
    return stored(full.unionByName(state.select("source", "source_size", "target", "whole", (F.col("below") + (F.col("rest") * 2 >= F.col("n")).cast("long")).alias("below"))), "cuts")


def copies(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """docs with mix_size, mix_hash, mix_source_size, mix_target and mix_copies, the times that the mix takes the document."""
    s = sized(packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text")))
    small = stored(s.select("source", "mix_size", "mix_hash"), "sizes")
    goals = targets(small.groupBy("source").agg(F.sum("mix_size").alias("source_size")), weights, most)
    cut = thresholds(small, goals).withColumnRenamed("source", "of")
    out = s.join(cut, s["source"].eqNullSafe(cut["of"]), "left")
    taken = F.col("whole") + (F.col("mix_hash") < F.col("below")).cast("long")
    return unpacked(out, docs, mix_size=F.col("mix_size"), mix_hash=F.col("mix_hash"), mix_source_size=F.col("source_size"), mix_target=F.col("target"), mix_copies=taken)
