"""Substring dedup by suffix automata of reference shards.

A window is ``window`` consecutive words of one document. A word goes if a window over it has a word sequence that also starts in
a document with a smaller doc_id.

Which reference a document must be matched against is found first: each window has an anchor, the run of ``gram`` words in it
whose hash is least, so equal windows have equal anchors. The smallest document that holds an anchor is its reference. The
references' windows are dealt to shards of bounded size, by document, and those of a very long one by anchor as well. Each shard's
automaton is sent to as many tasks as the
text that must stream through it asks for, and only those documents are streamed that share an anchor with it, so neither the
number of shards nor a passage that very many documents share makes all meet all. Matching statistics give for each window
whether a smaller document of the shard holds it. A window that its anchor's reference doesn't hold can still be shared with
a third document, as at the edges of a passage: for these an exact check groups the windows by a 128-bit hash.

Null and empty texts have no words. Rows without doc_id are left as they are. Rows with equal doc_id aren't duplicates of each
other, and their texts may differ: spans and cuts belong to a doc_id and the 64-bit hash of a text (text_key), so only rows equal
in both share them. Of the input only doc_id and text are used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lantern.llm.automaton import SuffixAutomaton
from lantern.llm.common import as_bytes, hash_words, kgrams, slices, stored
from lantern.llm.components import spread_join

WINDOW, GRAM = 50, 8
#: Words of a shard's references, and of the text that one task streams through its automaton.
SHARD_WORDS, TASK_WORDS = 60_000, 1_000_000


def _anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its anchor's hash and position. The first one wins a tie."""
    g = kgrams(h, gram)
    inside = window - gram + 1
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.concatenate([np.lib.stride_tricks.sliding_window_view(g[i : i + 50_000 + inside - 1], inside).argmin(axis=1) + np.arange(i, min(i + 50_000, len(g) - inside + 1)) for i in range(0, len(g) - inside + 1, 50_000)])
    return g[at].view(np.int64), at


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [tuple(x) for x in edges.reshape(-1, 2).tolist()]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text."""
    return docs.select("doc_id", as_bytes().alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def signatures(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, sha256 of all words joined, anchors (distinct)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, sha, anchors = [], [], []
                for text in part.column(2).to_pylist():
                    w = text.split()
                    n.append(len(w))
                    sha.append(_sha(w))
                    anchors.append(np.unique(_anchors(hash_words(w), window, gram)[0]) if len(w) >= window else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, anchors)]), pa.int32()), pa.array(np.concatenate(anchors), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sha), lists], ["doc_id", "text_key", "n_words", "sha", "anchors"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_key long, n_words long, sha string, anchors array<long>")


def _regions(cand: DataFrame, window: int, gram: int) -> DataFrame:
    """Of (doc_id, text_key, text, shared (anchor, first, piece)): runs of windows whose anchor another document has, with the
    reference's doc_id and its piece."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text_key, text, shared in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    w = text.split()
                    key, _ = _anchors(hash_words(w), window, gram)
                    keys = np.array([s["anchor"] for s in shared], np.int64)
                    owners, owner = np.unique(np.array([(s["first"], s["piece"]) for s in shared], np.int64), axis=0, return_inverse=True)
                    order = np.argsort(keys)
                    keys, owner = keys[order], owner.ravel()[order]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    ref = np.where(keys[at] == key, owner[at], -1)
                    edges = np.concatenate(([0], np.flatnonzero(np.diff(ref)) + 1, [len(ref)]))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        if ref[a] >= 0:
                            of, piece = owners[ref[a]].tolist()
                            rows.append((doc, text_key, of, piece, a, b - a + window - 1, b" ".join(w[a : b + window - 1])))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "text_key", "first", "piece", "start", "n", "words"])

    return cand.mapInArrow(run, "doc_id long, text_key long, first long, piece int, start int, n int, words binary")


def _matches(dealt: DataFrame, window: int) -> DataFrame:
    """Streams each shard's documents through its automaton; rows come by (shard, salt), references first.

    Out: runs of words to remove (start, end), or the hash of a window to check (h1, h2 at start).
    """

    def rows_of(batches):
        for batch in batches:
            for part in slices(batch):
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    def run(batches):
        current, vocab, machine, done = None, {}, None, False
        out: list[tuple] = []
        for shard, salt, query, doc, text_key, start, text in rows_of(batches):
            if (shard, salt) != current:
                current, vocab, machine, done = (shard, salt), {}, SuffixAutomaton(), False
            w = text.split()
            if not query:
                machine.add([vocab.setdefault(x, len(vocab)) for x in w], doc)
                continue
            if not done:
                machine.finish()
                done = True
            held = np.zeros(len(w) - window + 1, bool)
            for i, (state, longest) in enumerate(machine.matching([vocab.get(x, -1) for x in w])):
                if longest >= window and machine.holder(state, window) < doc:
                    held[i - window + 1] = True
            out += [(doc, text_key, start + a, start + b + window - 1, None, None) for a, b in _runs(held)]
            if not held.all():
                h = hash_words(w)
                one, two = kgrams(h, window, 1).view(np.int64), kgrams(h, window, 2).view(np.int64)
                out += [(doc, text_key, start + i, None, int(one[i]), int(two[i])) for i in np.flatnonzero(~held).tolist()]
            if len(out) > 5000:
                yield packed(out)
                out = []
        yield packed(out)

    def packed(rows):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "text_key", "start", "end", "h1", "h2"])

    return dealt.mapInArrow(run, "doc_id long, text_key long, start int, end int, h1 long, h2 long")


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, signed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(removed, candidates): removed is doc_id, text_key and runs of words (start, end) that go; candidates holds each of these texts once."""
    signed = stored(signatures(docs, window, gram), "anchors") if signed is None else signed
    held = signed.where("doc_id is not null").select("doc_id", "text_key", "n_words", F.explode("anchors").alias("anchor"))
    shared = held.groupBy("anchor").agg(F.min(F.struct("doc_id", "n_words")).alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("held")).where("least.doc_id < last")
    pieces = F.ceil(F.col("least.n_words") / SHARD_WORDS)
    shared = stored(shared.select("anchor", F.col("least.doc_id").alias("first"), F.pmod("anchor", pieces).cast("int").alias("piece"), "held"), "shared")
    total = signed.agg(F.sum(F.size("anchors"))).first()[0] or 0
    by_doc = spread_join(held.select("doc_id", "text_key", "anchor"), shared, "anchor", total).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("anchor", "first", "piece")).alias("shared"))
    cand = _texts(docs).join(by_doc, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "shared")
    cand = stored(cand.dropDuplicates(["doc_id", "text_key"]), "candidates")
    regions = stored(_regions(cand, window, gram), "regions")
    refs = regions.where("doc_id = first").groupBy(F.lit(1)).agg(F.sum("n").alias("n")).first()
    shards = max(1, -(-(refs["n"] if refs else 0) // SHARD_WORDS))
    placed = regions.withColumn("shard", F.pmod(F.xxhash64("first", "piece"), F.lit(shards)).cast("int")).withColumn("query", (F.col("doc_id") != F.col("first")).cast("int"))
    loads = placed.where("query = 1").groupBy("shard").agg(F.sum("n").alias("load")).select("shard", F.ceil(F.col("load") / TASK_WORDS).cast("int").alias("tasks"))
    salted = placed.join(loads, "shard")
    salts = F.when(F.col("query") == 0, F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("tasks")).cast("int")))
    salted = salted.withColumn("salt", F.explode(salts)).select("shard", "salt", "query", "doc_id", "text_key", "start", "words")
    dealt = salted.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "query", "doc_id")
    matched = stored(_matches(dealt, window), "matches")
    open_ = matched.where("end is null").select("doc_id", "text_key", "start", "h1", "h2")
    least = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    late = open_.join(least, ["h1", "h2"]).where("doc_id > first").selectExpr("doc_id", "text_key", "start", f"start + {window} as end")
    return matched.where("end is not null").select("doc_id", "text_key", "start", "end").unionByName(late), cand


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space; null where none went)."""
    signed = stored(signatures(docs, window, gram), "anchors")
    removed, cand = spans(docs, window, gram, signed)
    runs = removed.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("runs"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, kept = [], []
                for text, rs in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    w = text.split()
                    keep = np.ones(len(w), bool)
                    for r in rs:
                        keep[r["start"] : r["end"]] = False
                    n.append(int(len(w) - keep.sum()))
                    kept.append(b" ".join(x for x, k in zip(w, keep.tolist(), strict=True) if k))
                sha = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array([k.decode() for k in kept])], ["of", "of_key", "n_removed", "new_sha", "kept"])

    cut = cand.select("doc_id", "text_key", "text").join(runs, ["doc_id", "text_key"]).mapInArrow(run, "of long, of_key long, n_removed long, new_sha string, kept string")
    joined = signed.select("doc_id", "text_key", "n_words", "sha").join(cut, (F.col("doc_id") == F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("new_sha", "sha").alias("kept_sha256"), "kept")
