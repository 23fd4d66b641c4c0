"""A corpus pipeline of five stages. Each takes what the one before has kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lantern.llm import decontamination, mixing, ngram_join, quality_model, sharding
from lantern.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = quality_model.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("q_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, a similarity of 0.8."""
    return ngram_join.first_of_each(docs, n=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of ten words and more of a benchmark item are cut; a document of which more than a tenth is hit goes. Shorter items don't count."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, length_limit=10, coverage_limit=0.1, short=False)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    mixed = mixing.copies(docs).where("mix_copies > 0")
    return mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy")).drop("mix_copy")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """shard and slot for each document; shards are near equal in bytes."""
    sized = docs.withColumn("shard_bytes", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"))
    return sharding.shard(sized, 24, size="shard_bytes").drop("shard_bytes")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("shards", shards)]

#: The classifier and the hashes of the mix can't be said in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
