"""A table of rows by id that can be written to: upserts, deletes, whole batches once only.

Each write puts its rows into a folder of its own and then names that folder in a new manifest, the next number of a sequence. A
manifest is written aside and renamed, so a write is seen whole or not at all: what a crash leaves between the data and the manifest is a
folder that no manifest names. Writing costs what is written, whatever the table holds; reading takes for each id the row of
the highest version, by one aggregation on the id, and leaves out deleted ones. ``compact`` writes what is read as one folder.

A batch has a number within its source; the manifest remembers the last one, and a batch that comes again, or an older one, changes
nothing. Null ids are refused. Of repeated ids in a batch the row that is greatest in ``order`` stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def condition(filters: dict) -> Column:
    """All filters: a list means any of its values, ``*`` at an end of a string means any text there, else equality."""
    out = F.lit(True)
    for name, value in filters.items():
        c = F.col(name)
        if isinstance(value, list):
            out &= c.isin(value)
        elif isinstance(value, str) and (value.startswith("*") or value.endswith("*")) and value:
            body = value.strip("*")
            here = F.contains(c, F.lit(body)) if value[0] == value[-1] == "*" else F.endswith(c, F.lit(body)) if value[0] == "*" else F.startswith(c, F.lit(body))
            out &= here
        else:
            out &= c == value
    return F.coalesce(out, F.lit(False))


class Conflict(RuntimeError):
    """Another writer has taken the next number."""


class Table:
    """A table in ``path``. ``first`` names columns that keep the value with which a row of an id was first written."""

    def __init__(self, spark: SparkSession, path: str, id: str, schema: str, first: tuple[str, ...] = ()):
        self.spark, self.path, self.id, self.schema, self.first = spark, path.rstrip("/"), id, schema, first
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def manifest(self) -> dict:
        """The latest: number, folders, last batch of each source."""
        folder = self._at("manifests")
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        names = sorted(n for n in found if n.endswith(".json"))
        if not names:
            return {"number": 0, "folders": [], "batches": {}}
        stream = self._fs.open(self._at(f"manifests/{names[-1]}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        final, aside = self._at(f"manifests/{manifest['number']:012d}.json"), self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise Conflict(f"{final} is there")

    def _write(self, rows: DataFrame, old: dict, source: str | None, batch: int | None, folders: list[str]) -> None:
        number, name = old["number"] + 1, f"data/{old['number'] + 1}-{uuid.uuid4().hex}"
        rows.withColumn("_version", F.lit(number).cast("long")).write.parquet(f"{self.path}/{name}")
        batches = old["batches"] | ({source: batch} if source is not None else {})
        self._commit({"number": number, "folders": [*folders, name], "batches": batches})

    def _done(self, old: dict, source: str | None, batch: int | None) -> bool:
        return source is not None and batch is not None and old["batches"].get(source, -1) >= batch

    def _versions(self, manifest: dict) -> DataFrame:
        stored = self.spark.createDataFrame([], self.schema).withColumn("_deleted", F.lit(False)).withColumn("_version", F.lit(0).cast("long"))
        if not manifest["folders"]:
            return stored
        return self.spark.read.schema(stored.schema).parquet(*(f"{self.path}/{f}" for f in manifest["folders"]))

    def read(self) -> DataFrame:
        every = self._versions(self.manifest())
        names = [c for c in every.columns if c not in (self.id, "_version", "_deleted")]
        rest = F.struct(*(F.col(c) for c in names), "_deleted")
        # a deletion begins a row's life anew: its first values count from there
        life = F.max(F.when(F.col("_deleted"), F.col("_version")))
        alive = every.join(every.where("_deleted").groupBy(self.id).agg(life.alias("_gone")), self.id, "left").where("_gone is null or _version > _gone")
        last = alive.groupBy(self.id).agg(F.max_by(rest, "_version").alias("_last"), *(F.min_by(c, "_version").alias(f"_first_{c}") for c in self.first))
        return last.select(self.id, *(F.col(f"_first_{c}").alias(c) if c in self.first else F.col(f"_last.{c}").alias(c) for c in names))

    def upsert(self, rows: DataFrame, order: str | None = None, source: str | None = None, batch: int | None = None) -> bool:
        """False if this batch is in the table already."""
        old = self.manifest()
        if self._done(old, source, batch):
            return False
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        if rows.where(F.col(self.id).isNull()).limit(1).count():
            raise ValueError(f"{self.id} is null")
        rest = F.struct(*([F.col(order)] if order else []), *(F.col(c).alias(f"v_{c}") for c in names if c != self.id))
        one = rows.groupBy(self.id).agg(F.max(rest).alias("_row")).select(*(F.col(c) if c == self.id else F.col(f"_row.v_{c}").alias(c) for c in names))
        self._write(one.withColumn("_deleted", F.lit(False)), old, source, batch, old["folders"])
        return True

    def delete(self, filters: dict, source: str | None = None, batch: int | None = None) -> int:
        """How many rows went."""
        old = self.manifest()
        if self._done(old, source, batch):
            return 0
        gone = self.read().where(condition(filters)).withColumn("_deleted", F.lit(True))
        self._write(gone, old, source, batch, old["folders"])
        return self._versions(self.manifest()).where(F.col("_deleted") & (F.col("_version") == old["number"] + 1)).count()

    def replace(self, rows: DataFrame, filters: dict, source: str | None = None, batch: int | None = None) -> bool:
        """Deletes what the filters hold and writes rows, as one version: readers see neither half."""
        old = self.manifest()
        if self._done(old, source, batch):
            return False
        kept = self.read().where(condition(filters)).join(rows.select(self.id), self.id, "left_anti").withColumn("_deleted", F.lit(True))
        names = [c for c in kept.columns if c != "_deleted"]
        fresh = rows.dropDuplicates([self.id]).select(*names).withColumn("_deleted", F.lit(False))
        self._write(kept.unionByName(fresh), old, source, batch, old["folders"])
        return True

    def compact(self) -> None:
        """One folder with what is read. Older folders stay for those who read them; ``vacuum`` takes what the latest manifest doesn't name."""
        self._write(self.read().withColumn("_deleted", F.lit(False)), self.manifest(), None, None, [])

    def vacuum(self) -> list[str]:
        named, folder = set(self.manifest()["folders"]), self._at("data")
        stale = [n for s in (self._fs.listStatus(folder) if self._fs.exists(folder) else []) if (n := f"data/{s.getPath().getName()}") not in named]
        for name in stale:
            self._fs.delete(self._at(name), True)
        return stale


def sink(stream: DataFrame, table: Table, checkpoint: str, source: str, order: str | None = None):
    """A query that upserts each batch of a stream once, whatever is run again."""
    writer = stream.writeStream.foreachBatch(lambda rows, number: table.upsert(rows, order, source, number) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
