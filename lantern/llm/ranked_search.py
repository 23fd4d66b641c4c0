"""Ranked lexical search by hashed max-sketches.

The index holds a sketch of each document: its terms are hashed to ``WIDTH`` coordinates, and each coordinate keeps the largest number
of occurrences among its terms. What a term adds to a score grows with that number, so at a coordinate the largest impact of its
terms is kept as well, and a document's coordinatewise maxima bound the score of any query from above. Sketches are stored
sparsely, three bytes a coordinate; 255 stands for 255 occurrences and more, whose impact is bounded by its limit. The index also
holds in how many documents each term stands, and needs one pass over the texts; it doesn't depend on the queries.

A batch of queries is looked up in all sketches at once. In the first round each query's ``FIRST`` documents of the highest bounds
are scored exactly from their whole texts; the k-th best of these scores is the threshold. In the second round all other documents
whose bound isn't below the threshold, in the order of score and doc_id, are scored exactly as well; none behind them can be among
the k best. So results are exact, whatever collides in the sketches. Batches are cut by their number of terms; each passes over the
index twice and over the texts (in the JVM, candidates only leave it) twice.

A term is a maximal run of letters, digits and characters beyond ASCII, with A-Z lower-cased; null and empty texts have none. Scores
are whole numbers. Equal scores stand by ascending doc_id, a null one last; rows of equal doc_id are documents of their own and share
a rank in any order. Items equal in id and text are one item; items of one id with different texts are ranked each for itself,
as is an item without id. Items without terms, or with none that a document holds, have no rows. No documents or no items: no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lantern.llm.common import as_bytes, slices, stored

WIDTH, SATURATED = 1 << 16, 255
#: Documents that are scored for each query before the threshold is known.
FIRST = 32
#: Query terms of a batch; entries of a bound matrix and of a list before it is cut; pairs up to which candidates are broadcast.
BATCH_TERMS, ENTRIES, BROADCAST = 50_000, 1_000_000, 200_000
#: Distinct terms whose counts a task holds before it gives them out.
HELD_TERMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _coordinates(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % WIDTH for w in words), np.int64)


def _key(id: str, text: str):
    return F.xxhash64(F.col(id), F.coalesce(F.col(text), F.lit("")))


def index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table with two kinds of rows: (id, key, n, places, most) of each document with terms, and (term, df), to be added up."""

    def run(batches):
        df: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                n, places, most = [], [], []
                for body in part.column(2).to_pylist():
                    words = terms(body)
                    tf = Counter(words)
                    df.update(tf.keys())
                    c = _coordinates(tf)
                    order = np.argsort(c, kind="stable")
                    at, first = np.unique(c[order], return_index=True)
                    counts = np.minimum(np.fromiter(tf.values(), np.int64, len(tf)), SATURATED)[order]
                    n.append(len(words))
                    places.append(at.astype("<u2").tobytes())
                    most.append((np.maximum.reduceat(counts, first) if len(at) else counts).astype(np.uint8).tobytes())
                none = pa.nulls(len(n))
                rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(places, pa.binary()), pa.array(most, pa.binary()), none.cast(pa.binary()), none.cast(pa.int64())], names)
                yield rows.filter(pa.array([x > 0 for x in n], pa.bool_()))
                if len(df) > HELD_TERMS:
                    yield counted(df)
                    df = Counter()
        yield counted(df)

    def counted(df):
        none = pa.nulls(len(df))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64())] * 3 + [none.cast(pa.binary())] * 2 + [pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names)

    names = ["id", "key", "n", "places", "most", "term", "df"]
    given = docs.select(F.col(id).cast("long").alias("id"), _key(id, text).alias("key"), as_bytes(text).alias("text"))
    return stored(given.mapInArrow(run, "id long, key long, n long, places binary, most binary, term binary, df long"), "sketches")


def _weighed(items: DataFrame, indexed: DataFrame, qid: str, text: str, total: int) -> DataFrame:
    """(query, item, term, held, weight) for the terms of the items that some document holds. A written table."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = items.select(_key(qid, text).alias("query"), F.col(qid).alias("item"), words.alias("words")).dropDuplicates(["query"])
    asked = asked.select("query", "item", F.explode("words").alias("word")).groupBy("query", "item", F.col("word").cast("binary").alias("term")).agg(F.count("*").alias("held"))
    df = indexed.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(total)) + 2) / (2 * F.col("df") + 1))).cast("long")
    return stored(asked.join(df, "term").select("query", "item", "term", "held", weight.alias("weight")).where("weight > 0"), "query-terms")


class _Batch:
    """The queries of one batch, as tasks need them: what each term adds, and by coordinate which queries ask for it."""

    def __init__(self, rows: list, docs: int, length: int):
        self.docs, self.length = docs, length
        names = {q: i for i, q in enumerate(dict.fromkeys(r["query"] for r in rows))}
        self.size = len(names)
        self.names = list(names)
        query, term = np.array([names[r["query"]] for r in rows], np.int64), [bytes(r["term"]) for r in rows]
        weight = np.array([r["held"] * r["weight"] for r in rows], np.int64)
        self.by_term: dict[bytes, list[tuple[int, int]]] = {}
        for q, t, w in zip(query.tolist(), term, weight.tolist(), strict=True):
            self.by_term.setdefault(t, []).append((q, w))
        at = _coordinates(term)
        order = np.argsort(at, kind="stable")
        self.query, self.weight = query[order], weight[order].astype(float)
        self.starts = np.searchsorted(at[order], np.arange(WIDTH + 1))

    def slope(self, n: int) -> int:
        return 8 * (25 + 75 * n * self.docs // self.length)

    def bounds(self, n: list, places: list, most: list) -> np.ndarray:
        """(documents, queries): sums of whole numbers below 2**53, so exact."""
        lengths = np.array([len(m) for m in most])
        at, tf = np.frombuffer(b"".join(places), "<u2").astype(np.int64), np.frombuffer(b"".join(most), np.uint8).astype(np.int64)
        asked = np.flatnonzero(self.starts[at + 1] > self.starts[at])
        doc, at, tf = np.repeat(np.arange(len(n)), lengths)[asked], at[asked], tf[asked]
        impact = np.where(tf == SATURATED, 1_000_000, 1_000_000_000 * tf // (1000 * tf + np.array([self.slope(x) for x in n], np.int64)[doc]))
        count = self.starts[at + 1] - self.starts[at]
        ends, out, start = np.cumsum(count), np.zeros(len(n) * self.size), 0
        while start < len(at):  # a word of all documents and all queries makes very many entries
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ENTRIES // 4, "right")))
            some = slice(start, stop)
            first = np.repeat(self.starts[at[some]] - (ends[some] - count[some]), count[some])
            which = np.arange(ends[start] - count[start], ends[stop - 1]) + first
            cell = np.repeat(doc[some], count[some]) * self.size + self.query[which]
            out += np.bincount(cell, np.repeat(impact[some], count[some]) * self.weight[which], len(out))
            start = stop
        return out.reshape(len(n), self.size)

    def scores(self, text: bytes, wanted: list[int]) -> list[int]:
        words = terms(text)
        slope, out = self.slope(len(words)), dict.fromkeys(wanted, 0)
        for term, tf in Counter(words).items():
            for q, w in self.by_term.get(term, ()):
                if q in out:
                    out[q] += w * (1_000_000_000 * tf // (1000 * tf + slope))
        return [out[q] for q in wanted]


def _candidates(indexed: DataFrame, shared, least: np.ndarray | None, last: np.ndarray | None) -> DataFrame:
    """(query, key, id, bound). Without ``least`` the ``FIRST`` highest bounds of each query in each task; else all that aren't behind (least, last)."""

    def run(batches):
        batch_of = shared.value
        floor = np.zeros(batch_of.size) if least is None else least
        parts: list[np.ndarray] = []
        held = 0

        def cut(parts):
            """The ``FIRST`` of each query, and the new floor."""
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows["id"], -rows["bound"], rows["query"]))]
            starts = np.searchsorted(rows["query"], np.arange(batch_of.size + 1))
            rank = np.arange(len(rows)) - starts[rows["query"]]
            full = starts[1:] - starts[:-1] >= FIRST
            floor[full] = rows["bound"][starts[:-1][full] + FIRST - 1]
            return rows[rank < FIRST]

        for batch in batches:
            for part in slices(batch, max(1, min(512, ENTRIES // max(1, batch_of.size)))):
                ids, keys, n, places, most = (c.to_pylist() for c in part.columns)
                bound = batch_of.bounds(n, places, most)
                ids = np.array([_NO_ID if x is None else x for x in ids], np.int64)
                fit = (bound >= floor) & (bound > 0)
                if last is not None:
                    fit &= (bound > floor) | (ids[:, None] <= last)
                doc, query = np.nonzero(fit)
                rows = np.empty(len(doc), [("query", np.int64), ("key", np.int64), ("id", np.int64), ("bound", float)])
                rows["query"], rows["key"], rows["id"], rows["bound"] = query, np.array(keys, np.int64)[doc], ids[doc], bound[doc, query]
                parts.append(rows)
                held += len(rows)
                if least is None and held > ENTRIES // 10:
                    parts = [cut(parts)]
                    held = len(parts[0])
                elif least is not None and held:
                    yield given(rows)
                    parts, held = [], 0
        if parts:
            yield given(cut(parts) if least is None else np.concatenate(parts))

    def given(rows):
        ids = pa.array(rows["id"], pa.int64(), mask=rows["id"] == _NO_ID)
        return pa.RecordBatch.from_arrays([pa.array(rows["query"].astype(np.int32)), pa.array(rows["key"]), ids, pa.array(rows["bound"].astype(np.int64))], ["query", "key", "id", "bound"])

    docs = indexed.where("n is not null").select("id", "key", "n", "places", "most")
    return docs.mapInArrow(run, "query int, key long, id long, bound long")


def _rescored(docs: DataFrame, wanted: DataFrame, shared, small: bool, id: str, text: str) -> DataFrame:
    """(query, id, score) of the pairs ``wanted`` (query, key), from the whole texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                out = [(q, i, s) for i, body, queries in zip(*(c.to_pylist() for c in part.columns), strict=True) for q, s in zip(queries, shared.value.scores(body, queries), strict=True) if s]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "id", "score"])

    lists = wanted.groupBy("key").agg(F.collect_set("query").alias("queries"))  # at most the queries of a batch
    texts = docs.select(_key(id, text).alias("key"), F.col(id).cast("long").alias("id"), as_bytes(text).alias("text"))
    return texts.join(F.broadcast(lists) if small else lists, "key").select("id", "text", "queries").mapInArrow(run, "query int, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", qid: str = "item_id", text: str = "text", indexed: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, score): the k documents of the highest score above 0 for each item."""
    spark = docs.sparkSession
    indexed = index(docs, id, text) if indexed is None else indexed
    total, length = indexed.agg(F.count("n"), F.sum("n")).first()
    weighed = _weighed(items, indexed, qid, text, total)
    batches = max(1, -(-weighed.count() // BATCH_TERMS))
    names = weighed.select("query", F.col("item").alias(qid)).distinct()
    found = spark.createDataFrame([], f"query long, {id} long, score long")
    best = lambda key: Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    for i in range(batches):
        rows = weighed.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == i).collect()  # about BATCH_TERMS
        if not rows:
            continue
        batch = _Batch(rows, total, length)
        shared = spark.sparkContext.broadcast(batch)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("bound").desc(), F.col("id").asc_nulls_last()))
        first = stored(_candidates(indexed, shared, None, None).withColumn("place", place).where(F.col("place") <= FIRST), "highest")
        one = stored(_rescored(docs, first, shared, batch.size * FIRST <= BROADCAST, id, text), "scored")
        kth = one.withColumn("place", F.row_number().over(best("query"))).where(F.col("place") == k).select("query", "id", "score").collect()  # one a query
        least, last = np.ones(batch.size), np.full(batch.size, _NO_ID)
        for r in kth:
            least[r["query"]], last[r["query"]] = r["score"], _NO_ID if r["id"] is None else r["id"]
        more = stored(_candidates(indexed, shared, least, last).join(first.select("query", "key"), ["query", "key"], "left_anti"), "above")
        two = _rescored(docs, more, shared, more.count() <= BROADCAST, id, text)
        scored = one.unionByName(two).withColumn("place", F.row_number().over(best("query"))).where(F.col("place") <= k)
        key = F.element_at(F.lit(batch.names), F.col("query") + 1)
        scored = stored(scored.select(key.alias("query"), F.col("id").alias(id), "score"), "best")
        shared.unpersist()
        found = found.unionByName(scored)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(id).asc_nulls_last())).cast("int")
    return found.join(names, "query").select(qid, rank.alias("rank"), id, "score")
