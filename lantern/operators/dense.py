"""Dense search: exact cosine top-k of a query set against all rows, and an inverted file that compares only near cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Queries and rows that meet in one task.
QUERIES, ROWS = 4096, 8192
#: Rows that an inverted file is fitted on for each cell, the most cells, rounds of its fit, and rows that probes are tried on.
SAMPLE, CELLS, ROUNDS, TRIED = 40, 2048, 8, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _given(rows: DataFrame, id: str, vector: str, name: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"))


def _met(q: DataFrame, x: DataFrame, keys: list[str], qid: str, id: str, k: int, least: float, same: bool) -> DataFrame:
    """(qid, rank, id, similarity): the k best rows for each query among those that share ``keys`` with it, each pair once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("q").to_numpy(), right.column("x").to_numpy()
        if not len(a) or not len(b):
            return pa.table({qid: pa.array([], pa.int64()), id: pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        sims = np.round(_unit(_matrix(left.column("v"))) @ _unit(_matrix(right.column("v"))).T, 5)
        if not same:
            sims[a[:, None] == b[None, :]] = -np.inf
        bound = np.partition(sims, -k, axis=1)[:, -k, None] if len(b) > k else -np.inf
        i, j = np.nonzero((sims >= bound) & (sims >= least) & (sims > -np.inf))
        s = sims[i, j]
        order = np.lexsort((b[j], -s, i))  # of ties at the bound the smallest ids stay
        i, j, s = i[order], j[order], s[order]
        stay = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pa.table({qid: a[i[stay]], id: b[j[stay]], "similarity": s[stay]})

    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(run, f"{qid} long, {id} long, similarity double")
    best = Window.partitionBy(qid).orderBy(F.col("similarity").desc(), id)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(qid, "rank", id, "similarity")


def _part(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _all(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def knn(queries: DataFrame, rows: DataFrame, qid: str, id: str, vector: str, k: int = 10, least: float = -1.0, same: bool = False) -> DataFrame:
    """(qid, rank, id, similarity), exact. Blocks of queries meet blocks of rows, each pair of blocks in a task of its own.

    Rows with the query's own id are left out unless ``same``. Null vectors match nothing; vectors of length 0 are alike to none, so at 0.
    Ties go to the smaller id.
    """
    q, x = _given(queries, qid, vector, "q"), _given(rows, id, vector, "x")
    nq, nx = max(1, -(-q.count() // QUERIES)), max(1, -(-x.count() // ROWS))
    q = q.withColumn("qb", _part("q", nq)).withColumn("xb", _all(nx))
    x = x.withColumn("xb", _part("x", nx)).withColumn("qb", _all(nq))
    return _met(q, x, ["qb", "xb"], qid, id, k, least, same)


def fitted(rows: DataFrame, id: str, vector: str, k: int, recall: float) -> tuple[np.ndarray, int]:
    """(centres, probes): unit centres of cells, as many as the square root of the rows, up to ``CELLS``, fitted on ``SAMPLE`` rows for
    each, those of the least hashes; and in how many nearest cells ``TRIED`` of these rows find ``recall`` of their k nearest in the sample.

    In the sample neighbours lie farther away than among all rows, so the probes are rather too many.
    """
    x = _given(rows, id, vector, "x")
    cells = int(min(CELLS, max(1, np.sqrt(x.count()))))
    sample = x.orderBy(F.xxhash64("x"), "x").limit(SAMPLE * cells).select("v").toPandas()["v"]  # bounded
    data = _unit(np.array(sample.tolist(), float).reshape(len(sample), -1)) if len(sample) else np.empty((0, 0))
    if not len(data):
        return data, 0
    centres = data[np.linspace(0, len(data) - 1, min(cells, len(data))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, data)
        held = np.bincount(nearest, minlength=len(centres)) > 0
        centres = np.where(held[:, None], _unit(sums), centres)
    tried = np.linspace(0, len(data) - 1, min(TRIED, len(data))).astype(int)
    sims = data[tried] @ data.T
    sims[np.arange(len(tried)), tried] = -np.inf
    best = np.argsort(-sims, axis=1)[:, : min(k, len(data) - 1)]
    order = np.argsort(np.argsort(-(data[tried] @ centres.T), axis=1), axis=1)  # place of each cell for each tried row
    cell = (data @ centres.T).argmax(axis=1)
    places = np.sort(np.take_along_axis(order, cell[best], axis=1).ravel())
    return centres, int(places[min(len(places) - 1, int(recall * len(places)))]) + 1 if len(places) else 1


def _cells(rows: DataFrame, name: str, centres: np.ndarray, n: int) -> DataFrame:
    """rows with the n nearest cells of each, one a row."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_unit(_matrix(batch.column(1))) @ shared.value.T), axis=1, kind="stable")[:, :n]
                ends = np.arange(0, near.size + 1, near.shape[1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [name, "v", "cells"])

    return rows.mapInArrow(run, f"{name} long, v array<double>, cells array<int>").select(name, "v", F.explode("cells").alias("cell"))


def knn_near(queries: DataFrame, rows: DataFrame, qid: str, id: str, vector: str, k: int = 10, recall: float = 0.95, least: float = -1.0, same: bool = False) -> DataFrame:
    """As ``knn``, but each query meets only the rows of its nearest cells, as many as ``recall`` asks for; these are compared exactly.

    All rows are in the file, each in its nearest cell. A large cell is met in pieces of ``ROWS`` rows. The nearer rows lie to each
    other in groups, the fewer cells are met; vectors without any order need about half of all.
    """
    centres, probes = fitted(rows, id, vector, k, recall)
    if not len(centres):
        return knn(queries, rows, qid, id, vector, k, least, same)
    filed = _cells(_given(rows, id, vector, "x"), "x", centres, 1)
    sizes = filed.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("pieces"))  # a row for each cell, at most CELLS
    x = filed.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("x"), F.col("pieces")).cast("int")).drop("pieces")
    q = _cells(_given(queries, qid, vector, "q"), "q", centres, probes).join(F.broadcast(sizes), "cell")
    q = q.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    return _met(q, x, ["cell", "piece"], qid, id, k, least, same)
