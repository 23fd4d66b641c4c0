"""What must stay bounded whatever the rows: what a fit holds, what a task remembers, what a leader is compared with."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lantern.llm import pairing, quality_model, token_files


def test_fit_holds_one_row_for_each_labelled_document(spark, monkeypatch):
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("words of one document "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.range(2, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("other words "), F.col("id") % 3).alias("text")))
    labels = spark.range(1, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    seen = []
    plain = quality_model._logistic
    monkeypatch.setattr(quality_model, "_logistic", lambda x, y: seen.append(len(x)) or plain(x, y))
    quality_model.fit(docs, labels, sample=10)
    assert seen and max(seen) <= 10
    quality_model.fit(docs, labels, sample=1000)
    assert max(seen) == 39


def test_long_strings_are_not_remembered():
    import public_tokenizers

    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefXYZ0123/+") for _ in range(3000)) + " short words, here." for _ in range(200)] + ["é" * 500 + "!" for _ in range(3)]
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, [*encoder.known, *encoder.old])) <= token_files.LONG


def test_a_leader_of_very_many_is_given_once_to_each_group(spark):
    n = 20_000
    pairs = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    values = spark.range(0, n + 1).select(F.col("id").alias("key"), F.encode(F.concat(F.lit("x"), F.col("id") % 7), "UTF-8").alias("value"))
    met = lambda x, y: int(y[1:]) if y != b"x3" else None
    got = pairing.compared(pairs, values, bytes, met, key=pa.int64())
    rows = got.groupBy("a", "met").agg(F.count("*").alias("n")).collect()
    assert sorted((r["met"], r["n"]) for r in rows) == sorted((m, len([i for i in range(1, n + 1) if i % 7 == m])) for m in range(7) if m != 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        used = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(used) > 1 and max(used) < 0.6 * n
