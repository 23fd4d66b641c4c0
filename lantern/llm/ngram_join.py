"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

A document's n-grams are hashed to 64 bits. Documents with equal sets are one class, one row of the incidence. Since a pair that
links has so large an overlap, it shares one of the first ``n - ceil(t n) + 1`` n-grams of either document in any fixed order; only
these columns of the incidence are needed to find it. The order puts n-grams that are common in the corpus last, by a count sketch
over all documents that grows with them (it decides only the order, so results don't depend on it).

The incidence's column of an n-gram is a block: its documents. Each block is multiplied with one of its rows, the block's leader: that
in which the n-gram stands first, since of near copies the one with the fewest n-grams of its own is nearest to the others. Pairs are
discarded by bounds derived from their sizes, from the place of the n-gram (the first common one of a pair that links
stands early in both), and from parity sketches: bits flipped by each n-gram, of which two sets differ in no more places than in
n-grams. For what is left the overlap counts of these columns are accumulated: with ``met`` n-grams in common there, a pair can't
have more than ``met`` and what the larger rest of the two rows holds, which discards all pairs that don't reach the overlap that
their sizes ask for. The pairs that then remain get the product of their whole rows, a block leader's row at a time, and their
exact overlap decides. Documents that links with leaders connect need no comparison among themselves; the other pairs of a block
are multiplied as well, under the same bounds. So all links between classes are found or implied by components, and a large group of
near copies doesn't become all of its pairs.

Null, empty and blank texts have no n-grams and link with nothing. Rows without doc_id get no component. Rows that are equal in
doc_id and text are copies; rows of one doc_id with different texts are documents of their own, so inside a row's key is the 64-bit
hash of both. Texts with fewer than n words have one n-gram, all of their words; very long texts are taken whole. Of the input only
doc_id and text are used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lantern.llm.common import as_bytes, hash_words, kgrams, packed, slices, small_batches, stored, unpacked
from lantern.llm.components import components, contracted, spread_join
from lantern.llm.pairing import compared, overlap

#: The sketch has a counter for about ``USUAL`` n-grams, 2**LEAST to 2**MOST of them, in pieces of 2**PIECE.
USUAL, LEAST, MOST, PIECE = 256, 16, 24, 13
#: 64-bit words of a parity sketch.
PARITY = 8


def grams(text: bytes, n: int) -> np.ndarray:
    """The distinct n-grams of a text, as sorted hashes."""
    h = hash_words(text.lower().split())
    if 0 < len(h) < n:
        return kgrams(h, len(h), seed=len(h))
    return np.unique(kgrams(h, n))


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter, how common its n-grams are: 0, or 1 and more by powers of two above the usual."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST, max(LEAST, int(size / 6 / USUAL).bit_length()))  # a word has about six bytes

    def count(batches):
        sums = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    np.add.at(sums, (grams(text, n) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        pieces = [zlib.compress(p.astype(np.uint64).tobytes(), 1) for p in sums.reshape(-1, 1 << PIECE)]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(pieces)), pa.int32()), "counts": pa.array(pieces, pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(counts), np.uint64)
                sums[piece] = sums[piece] + x if piece in sums else x
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())})

    schema = "piece int, counts binary"
    parts = docs.select(as_bytes().alias("text")).mapInArrow(count, schema)
    with small_batches(docs.sparkSession):
        rows = parts.repartition(1 << (bits - PIECE), "piece").mapInArrow(add, schema).collect()  # at most 2**MOST counters
    out = np.zeros((1 << (bits - PIECE), 1 << PIECE))
    for r in rows:
        out[r["piece"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    usual = np.median(out)
    over = np.maximum(out - usual - 6 * np.sqrt(usual) - 16, 0).ravel()
    return np.where(over > 0, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def _key():
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """key, doc_id, n_shingles, print (of the set), parity and prefix (the n-grams of the incidence that matter), a written table."""
    rank = _sketch(docs, n)
    shift = np.uint64(64 - (len(rank).bit_length() - 1))
    common = docs.sparkSession.sparkContext.broadcast(rank)

    def sign(batches):
        rank = common.value
        for batch in batches:
            for part in slices(batch, 1024):
                sizes, prints, prefixes, flips = [], [], [], []
                for text in part.column(2).to_pylist():
                    g = grams(text, n)
                    size = len(g)
                    sizes.append(size)
                    prints.append(xxhash.xxh3_128_digest(g.tobytes()))
                    flips.append(np.packbits(np.bincount((g & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1).view(np.int64))
                    order = np.argsort(rank[(g >> shift).astype(np.int64)], kind="stable")
                    prefixes.append(g[order[: size - -(-num * size // den) + 1]].view(np.int64) if size else np.empty(0, np.int64))
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
                parity = pa.ListArray.from_arrays(pa.array(range(0, PARITY * len(flips) + 1, PARITY), pa.int32()), pa.array(np.concatenate(flips)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), parity, lists], ["key", "doc_id", "n_shingles", "print", "parity", "prefix"])

    rows = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    out = stored(rows.mapInArrow(sign, "key long, doc_id long, n_shingles long, print binary, parity array<long>, prefix array<long>"), "prints")
    common.unpersist()
    return out


def _counted(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, met) of the pairs whose overlap may still be large enough.

    rows: key, n and the columns of the key's prefix that another row shares. met is the overlap in these columns. An n-gram of both
    that isn't among them stands behind the prefix of one of the two, so there are at most as many as that rest is long.
    """
    side = lambda k: rows.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("grams").alias(f"g{k}"))
    counted = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("met", F.size(F.array_intersect("ga", "gb")))
    rest = lambda k: f"ceil({num} * {k} / {den}) - 1"
    return counted.where(f"met + greatest({rest('na')}, {rest('nb')}) >= ceil({num} * (na + nb) / {num + den})").select("a", "b", "met")


def _exact(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, with inter: the product of a's whole row with those of its block, which are streamed past it in groups."""
    values = texts.withColumnRenamed("text", "value")
    return compared(pairs.select("a", "b"), values, lambda text: grams(text, n), overlap(num, den), key=pa.int64()).withColumnRenamed("met", "inter")


def _links(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """signatures; (print, n, rep, first) of each class; links (a, b, inter) between the keys of representatives; edges (a, b) that
    have the links' components."""
    signed = signatures(docs, n, num, den)
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("print", F.col("n_shingles").alias("n")).agg(F.min("key").alias("rep"), F.min("doc_id").alias("first"))
    reps = stored(reps, "classes")
    alone = full.join(reps.select("rep"), F.col("key") == F.col("rep"), "left_semi").dropDuplicates(["key"])
    incidence = alone.select("key", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "gram"))
    leaders = incidence.groupBy("gram").agg(F.count("*").alias("held"), F.min(F.struct("pos", "key", "n")).alias("lead")).where("held > 1")
    blocks = stored(incidence.join(leaders, "gram").select("gram", "key", "n", "pos", "lead", "held"), "blocks")
    rows = blocks.groupBy("key", "n").agg(F.collect_list("gram").alias("grams"))
    parity = full.select("key", "parity").dropDuplicates(["key"])
    # of pairs with sizes na, nb and places pa, pb of their first common n-gram: needed is the overlap of a pair that links
    needed = f"ceil({num} * (na + nb) / {num + den})"
    sizes = f"least(na, nb) * {den} >= greatest(na, nb) * {num} and pa + {needed} <= na and pb + {needed} <= nb"
    apart = " + ".join(f"bit_count(sa[{i}] ^ sb[{i}])" for i in range(PARITY))
    bits = f"{apart} <= na + nb - 2 * {needed}"
    star = blocks.where("key <> lead.key").selectExpr("lead.key a", "lead.n na", "lead.pos pa", "key b", "n nb", "pos pb").where(sizes)
    star = stored(star.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")), "pairs")
    held = star.groupBy("a").agg(F.count("*").alias("held"))  # a leader may have very many followers
    star = spread_join(star, parity.select(F.col("key").alias("a"), F.col("parity").alias("sa")).join(held, "a"), "a", star.count())
    star = star.join(parity.select(F.col("key").alias("b"), F.col("parity").alias("sb")), "b")
    star = stored(_counted(star.where(bits).select("a", "b"), rows, num, den), "star")
    # the other pairs of blocks of more than two: those that no links with leaders connect yet
    many = blocks.where("held > 2 and key <> lead.key").select("gram", "key", "n", "pos", F.col("lead.key").alias("leader"))
    texts = docs.select(_key().alias("key"), as_bytes().alias("text"))
    ids = star.select(F.explode(F.array("a", "b")).alias("key")).unionByName(many.select("key")).distinct()
    texts = stored(texts.join(ids, "key", "left_semi").dropDuplicates(["key"]), "texts")
    linked = stored(_exact(star, texts, n, num, den), "linked")
    # rows of one label are connected; that not all connected ones have one label only makes more pairs
    nearer = contracted(linked)
    least = nearer.groupBy("u").agg(F.min("v").alias("v"))
    labels = least.unionByName(least.select(F.col("v").alias("u"), "v").distinct().join(least.select("u"), "u", "left_anti"))
    labels = stored(labels, "labels")
    label = labels.select(F.col("u").alias("key"), F.col("v").alias("label"))
    lead = labels.select(F.col("u").alias("leader"), F.col("v").alias("lead_label"))
    placed = many.join(label, "key", "left").join(lead, "leader", "left").join(parity, "key")
    own, first = F.coalesce("label", "key"), F.coalesce("lead_label", "leader")
    placed = stored(placed.select("gram", "key", "n", "pos", "parity", own.alias("label"), (own == first).alias("joined")), "placed")
    x = placed.where("not joined").selectExpr("gram", "key x", "n na", "pos pa", "parity sa", "label lx")
    y = placed.selectExpr("gram g", "key y", "n nb", "pos pb", "parity sb", "label ly", "joined")
    rest = x.join(y, (F.col("gram") == F.col("g")) & (F.col("lx") != F.col("ly")) & (F.col("joined") | (F.col("x") < F.col("y"))) & F.expr(sizes) & F.expr(bits))
    rest = stored(rest.selectExpr("least(x, y) a", "greatest(x, y) b").distinct(), "rest")
    late = stored(_exact(_counted(rest, rows, num, den), texts, n, num, den), "late")
    return signed, reps, linked.unionByName(late), nearer.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(late.select("a", "b"))


def _labelled(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """reps with component_id, the smallest doc_id that links reach."""
    labels = stored(components(edges), "labels")
    least = labels.join(reps, F.col("node") == F.col("rep")).groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("held"))
    labels = spread_join(labels, least, "component", labels.count())
    return reps.join(labels, F.col("rep") == F.col("node"), "left").select("print", "n", "rep", F.coalesce("least", "first").alias("component_id"))


def links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes is doc_id, n_shingles, rep; links is a, b, inter between reps, as many as components need.

    A rep is the key of one row of its class; rows without n-grams or doc_id have none.
    """
    signed, reps, found, _ = _links(docs, n, num, den)
    classes = signed.where("doc_id is not null").join(reps.select("print", "rep"), "print", "left")
    return classes.unionByName(signed.where("doc_id is null").withColumn("rep", F.lit(None).cast("long"))).select("doc_id", "n_shingles", "rep"), found


def groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, the document's own included."""
    signed, reps, _, edges = _links(docs, n, num, den)
    out = signed.join(_labelled(reps, edges).select("print", "component_id"), "print", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group that links make: that of the smallest doc_id, a null one last.

    Rows with equal or no doc_id are documents of their own: of copies one stays, of different texts each is judged for itself.
    Texts without n-grams stay, all of them. Rows equal in doc_id and text share a key; of these any one is taken. Columns of any
    name are kept as they are.
    """
    rows = packed(docs, key=_key(), doc_id=F.col("doc_id"), text=F.col("text"))
    found = groups(rows.select(F.col("key").alias("doc_id"), "text"), n, num, den).where("n_shingles > 0")
    found = stored(found.select(F.col("doc_id").alias("key"), "component_id").distinct(), "components")
    ids = rows.select("key", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id").alias("place"))
    ids = ids.groupBy("key").agg(F.min("place").alias("place"), F.count("*").alias("n_rows"))
    placed = stored(ids.join(found, "key"), "places")
    kept = placed.groupBy("component_id").agg(F.min(F.struct("place", "key")).alias("kept")).select(F.col("kept.key").alias("key"), F.lit(True).alias("first"))
    judged = stored(placed.join(kept, "key", "left").select("key", "n_rows", F.coalesce("first", F.lit(False)).alias("first")), "judged")
    once = rows.join(judged.where("not first or n_rows > 1"), "key", "left_anti")
    many = rows.join(judged.where("first and n_rows > 1"), "key", "left_semi").dropDuplicates(["key"])
    return unpacked(once.select("row").unionByName(many.select("row")), docs)
