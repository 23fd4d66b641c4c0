"""Shared pieces: written intermediate tables, word splitting and hashing inside tasks."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Java regex of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch while intermediate tables are written: so many whole texts are in memory at once, twice over.
BATCH = 500


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode a local one stands in for it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lantern.work.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lantern-")
        spark.conf.set("lantern.work.dir", base)
    return base


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH):
    """Arrow batches of few rows for what is run inside: long texts come in small pieces to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/lantern-{uuid.uuid4().hex}-{name}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **columns) -> DataFrame:
    """``columns`` beside one column ``row`` that holds all of docs' own, so that none of their names can clash; see ``unpacked``."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*own).alias("row") if own else F.lit(None).alias("row"), *(c.alias(k) for k, c in columns.items()))


def unpacked(rows: DataFrame, docs: DataFrame, **columns) -> DataFrame:
    """docs' own columns of ``packed`` rows, and ``columns``."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *(c.alias(k) for k, c in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str = "text"):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)


def kgrams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, np.uint64((seed * 0x632BE59BD9B4E019 + k) & 0xFFFFFFFFFFFFFFFF))
    for j in range(k):
        acc = (acc ^ h[j : j + n]) * _P1
        acc ^= acc >> _S1
    acc *= _P2
    return acc ^ (acc >> _S2)


def slices(batch, size: int = 256):
    """Small pieces of an Arrow batch, so that few texts are Python objects at a time."""
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def portions(batch, column: int, most: int = 8 << 20):
    """Pieces of an Arrow batch, each of about ``most`` bytes of a text column at the most, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
