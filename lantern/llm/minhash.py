"""MinHash near-dedup: minima of universal hashes, banding, verification by signatures, components by alternating stars.

A document's set is its distinct ``n``-word shingles, hashed to 64 bits; documents with equal sets are one class. Of each set
``BANDS * ROWS`` minima are taken under hashes of the universal family x -> (a x + b mod 2^64) div 2^32, a odd. Two sets agree in a minimum
with the probability of their similarity s, so they agree in all of some band with 1 - (1 - s^ROWS)^BANDS: all but 2 in 10^10 of the
pairs at 0.85, where a wrong miss must also break a component to be seen. Classes that share a band are a block.

A signature holds four bits of each minimum and a parity sketch (bits flipped by each shingle). Two sets that link differ in few of the
minima (``FAR`` is over six standard deviations above the mean at the threshold) and in no more bits of the sketch than in shingles.
Signatures discard the other pairs of a block before any text moves; what remains is confirmed on the full sets. In a block each class
meets the block's leader, one of them by hash; only classes that links with leaders don't connect meet the others of the block
(``pairing.others``), so a large group of near copies doesn't become all of its pairs, and no link between components is lost.

Null, empty and blank texts have no shingles and link with nothing; texts of fewer than n words have one, all of their words; long
texts are taken whole, in pieces of the hash table's width. Rows without doc_id get no component and aren't kept as anyone's first. Rows equal in
doc_id and text are copies; rows of one doc_id with different texts are documents of their own. Only doc_id and text are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lantern.llm.common import as_bytes, slices, stored
from lantern.llm.ngram_join import grams
from lantern.llm.pairing import blocked, compared, labelled, others, overlap, row_key, star

BANDS, ROWS = 38, 5
#: Shingles hashed at once; 64-bit words of the four-bit minima and of the parity sketch.
WIDTH, NIBBLES, PARITY = 512, 12, 8
_RNG = np.random.default_rng(20_240_601)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_P1, _P2, _S1, _S2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29), np.uint64(32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """32-bit minima of a set that isn't empty under all hashes."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), WIDTH):
        np.minimum(out, (_A[:, None] * shingles[None, i : i + WIDTH] + _B[:, None]).min(axis=1), out=out)
    return out >> np.uint64(32)


def bands(m: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of rows of minima."""
    m = m.reshape(-1, BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _P2, m.shape[:2]).copy()
    for j in range(ROWS):
        acc = (acc ^ m[:, :, j]) * _P1
        acc ^= acc >> _S1
    acc *= _P2
    return acc ^ (acc >> _S2)


def sketch(m: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """NIBBLES words with the lowest four bits of each minimum, and PARITY words of parity bits."""
    low = np.zeros(NIBBLES * 16, np.uint8)
    low[: len(m)] = m & np.uint64(15)
    flips = np.bincount((shingles & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.concatenate(((low[::2] | low[1::2] << 4).view(np.int64), np.packbits(flips).view(np.int64)))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """key, doc_id, n_shingles, print (of the set), sketch and bands (empty without shingles). A written table."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch, 512):
                sizes, prints, sketches, keys = [], [], [], []
                for text in part.column(2).to_pylist():
                    g = grams(text, n)
                    sizes.append(len(g))
                    prints.append(xxhash.xxh3_128_digest(g.tobytes()))
                    if len(g):
                        m = minima(g)
                        sketches.append(sketch(m, g))
                        keys.append(bands(m)[0].view(np.int64))
                    else:
                        sketches.append(np.empty(0, np.int64))
                        keys.append(np.empty(0, np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x), pa.int64())) for x in (sketches, keys)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), *lists], ["key", "doc_id", "n_shingles", "print", "sketch", "bands"])

    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    return stored(rows.mapInArrow(sign, "key binary, doc_id long, n_shingles long, print binary, sketch array<long>, bands array<long>"), "signatures")


def _far(num: int, den: int) -> int:
    """Minima of which two sets at the threshold differ in more only with a probability below 10^-9."""
    k, p = BANDS * ROWS, (1 - num / den) * 15 / 16
    return int(k * p + 6.5 * (k * p * (1 - p)) ** 0.5)


def groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included) of each row, and kept."""
    signed = signatures(docs, n)
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = stored(full.groupBy("print", F.col("n_shingles").alias("n")).agg(F.min("key").alias("rep"), F.min("doc_id").alias("first")), "classes")
    alone = stored(full.join(reps.select(F.col("rep").alias("key")), "key", "left_semi").dropDuplicates(["key"]), "representatives")
    rows = alone.select(F.explode("bands").alias("block"), "key", F.col("n_shingles").alias("n"), F.lit(0).alias("pos"))
    lead = F.min(F.struct(F.xxhash64("key").alias("order"), "key", "n", "pos"))  # any one: the first or the shortest would be an outlier
    blocks = stored(blocked(rows, rows.groupBy("block").agg(F.count("*").alias("held"), lead.alias("lead"))), "blocks")
    differ = lambda x: f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)"
    minima_apart = " + ".join(differ(f"(sa[{i}] ^ sb[{i}])") for i in range(NIBBLES))
    bits_apart = " + ".join(f"bit_count(sa[{i}] ^ sb[{i}])" for i in range(NIBBLES, NIBBLES + PARITY))
    fits = f"least(na, nb) * {den} >= greatest(na, nb) * {num}"
    near = f"{bits_apart} <= na + nb - 2 * ceil({num} * (na + nb) / {num + den}) and {minima_apart} <= {_far(num, den)}"
    sketches = alone.select("key", "sketch")
    first = stored(star(blocks, sketches, fits, near), "star")
    met, prepare = overlap(num, den), lambda text: grams(text, n)
    ids = first.select(F.explode(F.array("a", "b")).alias("key")).unionByName(blocks.where("held > 2 and key <> lead.key").select("key")).distinct()
    texts = docs.select(row_key().alias("key"), as_bytes().alias("value"))
    texts = stored(texts.join(ids, "key", "left_semi").dropDuplicates(["key"]), "texts")
    linked = stored(compared(first, texts, prepare, met), "linked")
    rest, nearer = others(blocks, alone.select("key", "sketch", F.col("bands").alias("blocks")), linked, fits, near)
    late = stored(compared(stored(rest, "rest"), texts, prepare, met), "late")
    named = labelled(reps, nearer.unionByName(late.select("a", "b"))).select("print", "component_id")
    out = signed.join(named, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
