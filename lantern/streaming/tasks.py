"""Task states, incremental ingestion and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_state(events: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    """The latest status of each task, and how often it was started anew (an event of the first status after another)."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(ts, status)).alias("status"), F.max(ts).alias("updated_at"), F.count("*").alias("events"))


def tumbling(events: DataFrame, ts: str, width: str, *by: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window, for batches and, with ``late``, for streams."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, ts: str, gap: str, by: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str):
    """A query that appends each batch's new keys to a Parquet table; a batch that is run again adds nothing. Null keys are dropped."""

    def batch(df: DataFrame, _: int) -> None:
        spark, new = df.sparkSession, df.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            old = spark.read.parquet(target).select(key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(old, key, "left_anti")
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
