"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, with A-Z in lower case. A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window. The automaton of all items is built from a
broadcast list; each document's words are streamed through it, and where the longest matching length reaches a window's, its
words are hit. The list is broadcast in shards of about ``shard_words`` words, one at a time, so neither the driver nor a task
holds more (about 1 KB a word in a task); a longer item is cut into pieces that overlap by a window less one word. With more than
one shard the documents are written once with a key for each row, streamed once for each shard, and the hits are joined by that
key, so results don't depend on the number of shards.

Null and empty texts have no words. Items with equal texts all occur. Null item ids are shown as "null". Each row of the documents
stands for itself, whatever its doc_id. Of the inputs only doc_id, text, item_id are used; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lantern.llm.automaton import SuffixAutomaton
from lantern.llm.common import as_bytes, slices, stored

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Words of the items of one shard.
SHARD_WORDS = 100_000
SCHEMA = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Items:
    """The automaton of some items, and which of them have a window. Without ``short``, items of fewer than n words have none."""

    def __init__(self, items: list[tuple[str, bytes]], n: int, short: bool = True) -> None:
        self.n, self.vocab = n, {}
        self.automaton = SuffixAutomaton()
        self.windows: dict[tuple[int, ...], list[str]] = defaultdict(list)
        for item, text in items:
            found = words(text)
            if len(found) < n and not short:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in found]
            self.automaton.add(ids, 0)
            m = min(n, len(ids))
            for window in {tuple(ids[i : i + m]) for i in range(len(ids) - m + 1)} if ids else ():
                self.windows[window].append(item)
        self.lengths = sorted({len(w) for w in self.windows})

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans (of word positions, end exclusive, in order and apart), items that occur."""
        found = words(text)
        if not self.lengths:
            return len(found), [], set()
        ids = np.fromiter((self.vocab.get(w, -1) for w in found), np.int64, len(found))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[list[int]] = []
        items: set[str] = set()
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start < self.lengths[0]:
                continue
            run = ids[start:end].tolist()
            for i, (_, longest) in enumerate(self.automaton.matching(run), 1):
                for m in self.lengths:
                    if longest < m:
                        break
                    held = self.windows.get(tuple(run[i - m : i]))
                    if held:
                        items.update(held)
                        at = start + i - m
                        while spans and spans[-1][0] >= at:
                            spans.pop()
                        if spans and spans[-1][1] >= at:
                            spans[-1][1] = start + i
                        else:
                            spans.append([at, start + i])
        return len(found), [(a, b) for a, b in spans], items


def _stream(docs: DataFrame, shared, n: int, key: str = "doc_id", short: bool = True, all_rows: bool = True) -> DataFrame:
    """The hits of each row as SCHEMA says, named by ``key``, in the broadcast items; of the rows that are hit only, unless ``all_rows``."""

    def run(batches):
        known = Items(shared.value, n, short)
        for batch in batches:
            for part in slices(batch):
                rows = [known.hits(t) for t in part.column(1).to_pylist()]
                spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))], [key, "n_words", "spans", "items"])
                yield out if all_rows else out.filter(pa.array([bool(r[1]) for r in rows], pa.bool_()))

    return docs.select(key, as_bytes().alias("text")).mapInArrow(run, SCHEMA.replace("doc_id", key, 1))


def _streams(docs: DataFrame, shards: list[DataFrame], n: int, key: str, short: bool = True, all_rows: bool = False) -> list[DataFrame]:
    """What ``_stream`` gives for each shard, as written tables: a shard leaves the driver and the tasks before the next one comes."""
    out = []
    for i, shard in enumerate(shards):
        shared = docs.sparkSession.sparkContext.broadcast(_held(shard))
        out.append(stored(_stream(docs, shared, n, key, short, all_rows and i == 0), "hits"))
        shared.destroy()
    return out


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its own for each row, written so that it stays, and the key's name."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _joined(parts: list[DataFrame], key: str) -> DataFrame:
    """The hits of some shards as one row for each key."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    joined = every.groupBy(key).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return joined.withColumn("spans", _union("spans"))


def _shards(items: DataFrame, shard_words: int, n: int = 10) -> list[DataFrame]:
    """Tables (item, text), each of about ``shard_words`` words."""
    step = max(n, shard_words)
    found = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("w", found)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1), F.lit(step)), lambda i: F.array_join(F.slice("w", i, step + n - 1), " "))
    cut = named.select("item", F.posexplode(F.when(F.size("w") > step, pieces).otherwise(F.array("text"))).alias("piece", "text"))
    sized = cut.withColumn("size", F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]+")) + 1).withColumn("bin", F.pmod(F.xxhash64("item", "piece"), F.lit(4096)))
    bins = sized.groupBy("bin").agg(F.sum("size").alias("all"))
    bins = bins.select("bin", (F.sum("all").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).alias("before"))
    inside = Window.partitionBy("bin").orderBy("item", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("sooner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bins, "bin")
    placed = stored(placed.select(F.floor((F.col("before") + F.col("sooner")) / shard_words).alias("shard"), "item", "text"), "items")
    numbers = [r[0] for r in placed.select("shard").distinct().orderBy("shard").collect()]
    return [placed.where(F.col("shard") == i).select("item", "text") for i in numbers]


def _held(shard: DataFrame) -> list[tuple[str, bytes]]:
    return [(r["item"], r["text"].encode()) for r in shard.collect()]  # of bounded size


def hits(docs: DataFrame, items: DataFrame, n: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans (hit words), items (ids as strings, sorted), a row for each row of docs."""
    shards = _shards(items, shard_words, n)
    if len(shards) < 2:
        return _stream(docs, docs.sparkSession.sparkContext.broadcast(_held(shards[0]) if shards else []), n)
    rows, key = _keyed(docs.select("doc_id", "text"))
    found = _joined(_streams(rows, shards, n, key, all_rows=True), key)
    return found.join(rows.select(key, "doc_id"), key).select("doc_id", "n_words", "spans", "items")


def _union(spans: str):
    """Overlapping and touching spans as one."""

    def add(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.expr("cast(array() as array<struct<start:int,end:int>>)"), add)


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, length_limit: int = 10, coverage_limit: float = 0.0, shard_words: int = SHARD_WORDS, short: bool = True) -> DataFrame:
    """docs, with the hit spans of at least ``length_limit`` words cut out of the texts, without those that are covered beyond a limit.

    A document of which more than the share ``coverage_limit`` of the words is hit goes as a whole. Spans shorter than
    ``length_limit`` (windows of short items) stay in the text but count as coverage; without ``short``, items of fewer than n
    words are left out altogether. The words on both sides of a cut are not matched again as one run. n_chars follows the text
    where there is one.
    """
    schema, names = docs.schema, docs.columns
    at = names.index("text")
    shards = _shards(items, shard_words, n)
    if not shards:
        return docs

    def cut(part, rows):
        """A piece of docs after what is hit of each text: its number of words and spans."""
        keep, texts = [], []
        for text, (count, spans) in zip(part.column(at).to_pylist(), rows, strict=True):
            cover = sum(b - a for a, b in spans)
            keep.append(cover <= coverage_limit * count)
            long = [s for s in spans if s[1] - s[0] >= length_limit]
            texts.append(_without(text.encode(), long).decode() if long and keep[-1] else text)
        out = part.set_column(at, names[at], pa.array(texts, part.schema.field(at).type))
        if "n_chars" in names:
            k = names.index("n_chars")
            old = part.column(at).to_pylist()
            chars = [c if t == o else len(t) for c, t, o in zip(part.column(k).to_pylist(), texts, old, strict=True)]
            out = out.set_column(k, "n_chars", pa.array(chars, part.schema.field(k).type))
        return out.filter(pa.array(keep, pa.bool_()))

    if len(shards) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_held(shards[0]))

        def run(batches):
            known = Items(shared.value, n, short)
            for batch in batches:
                for part in slices(batch):
                    yield cut(part, [known.hits((t or "").encode())[:2] for t in part.column(at).to_pylist()])

        return docs.mapInArrow(run, schema)

    keyed, key = _keyed(docs)
    found = stored(_joined(_streams(keyed, shards, n, key, short), key).select(key, "n_words", "spans"), "spans")
    found = found.select(F.col(key).alias("hit_row"), F.struct("n_words", "spans").alias("hit"))
    placed = keyed.join(found, keyed[key] == found["hit_row"], "left").select(*(keyed[c] for c in names), found["hit"].alias(key))

    def apply(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(h["n_words"], [(s["start"], s["end"]) for s in h["spans"]]) if h else (0, []) for h in part.column(len(names)).to_pylist()]
                yield cut(part.select(names), rows)

    return placed.mapInArrow(apply, schema)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these spans of words; what stands between two words of a span goes with them."""
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]])
