"""Token-ID files: each document's ids are compressed on their own with one shared zstandard dictionary.

``write`` makes Parquet datasets under one path, all by Spark's writers, so they may lie in any store it writes to:

* ``dictionary``: one row (hash, dictionary). The hash is the sha256 of the dictionary's bytes.
* ``blocks``: (block, dictionary_hash, tokens, places, data): the frames of about ``BLOCK`` bytes of documents, one after the
  other, and their places. Blocks hold documents in ascending doc_id order, nulls first; their numbers ascend too.
* ``index``: (doc_id, block, offset, bytes, start, n_tokens): where a document's frame lies in its block, and how many ids all
  documents before it have. ``heads``: (block, first): the same for blocks.

A frame holds the ids as little-endian 32-bit integers, grouped by byte (all lowest bytes first): the high bytes are mostly equal,
so they cost little. ``read`` decodes all documents, ``lookup`` single ones, reading their blocks only.

The dictionary is trained on the documents with the smallest hashes, at most ``SAMPLES`` of them, and of a long one on ``SLICES``
evenly spaced pieces of ``SLICE`` ids. Only the ratio depends on this; everything else covers all rows and whole texts.
A null or empty text is only the end id. Rows of equal doc_id follow each other in any order. Only doc_id and text are used.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lantern.llm.common import portions, slices

SAMPLES, DICTIONARY, BLOCK, LEVEL = 2000, 64 * 1024, 4 << 20, 3
SLICES, SLICE = 8, 256
#: Pieces that a task remembers with their ids, and characters of the longest that it does.
MEMORY, LONG = 500_000, 64
#: New pieces that are encoded as one text.
TOGETHER = 256
END = 2
#: White space twice, as Python's \s has it; Arrow's own is ASCII's.
_UNSAFE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"


class Encoder:
    """Ids of texts as arrays of little-endian 32-bit integers.

    No token of a byte-level vocabulary reaches over a line break between two other characters, or from there over a single space,
    so a text is cut there and each piece is encoded once while it is remembered: the last ``MEMORY`` pieces of up to ``LONG``
    characters, and as many before them. A batch's distinct pieces are found and put together by Arrow and numpy. New pieces are encoded many at a time with line
    breaks between them. Texts that begin with white space, have runs of it or an added token's string are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids by piece, and those of the generation before. A piece begins with its line break, or follows a space.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        (self.line,) = self._ids(["\n"])
        self.marks = dict(zip(".,!?", self._ids(list(".,!?")), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without line breaks, a few hundred in one text each time."""
        out, line = [], int.from_bytes(self.line, "little")
        runs = ["\n".join(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        for ids in self._ids(runs):
            cuts = (np.flatnonzero(np.frombuffer(ids, "<u4") == line) * 4).tolist()
            out += [ids[i:j] for i, j in zip([0, *(c + 4 for c in cuts)], [*cuts, len(ids)], strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.known) > MEMORY:
            self.old, self.known = self.known, {}
        known, old, marks = self.known, self.old, self.marks
        ended, words, others = [], set(), []
        out = list(map(known.get, pieces))
        at = [i for i, ids in enumerate(out) if ids is None]
        new = [pieces[i] for i in at]
        for p in new:
            ids = old.get(p)
            if ids is not None:
                known[p] = ids
            elif p.isalpha():
                words.add(p)
            elif p[-1:] in marks and p[:-1].isalpha():  # letters and a mark are two tokens' worth
                ended.append(p)
                if p[:-1] not in known:
                    words.add(p[:-1])
            else:
                others.append(p)
        heads, rest, alone = [], list(words), []
        for p in others:
            if not p or p[-1].isspace() or p[0].isspace() and (p[0] != "\n" or p[1:2].isspace()):
                alone.append(p)  # would touch the line break beside it
            else:
                (heads if p[0] == "\n" else rest).append(p)
        known.update(zip(alone, self._ids([p if p[:1] == "\n" else " " + p for p in alone]), strict=True))
        known.update(zip(heads, [self.line + ids for ids in self._many([p[1:] for p in heads])], strict=True))
        known.update(zip(rest, self._many([" " + p for p in rest]), strict=True))
        for p in ended:
            known[p] = known[p[:-1]] + marks[p[-1]]
        for i, p in zip(at, new, strict=True):
            out[i] = known[p]
        for some in (new, words):  # or long strings would fill the memory
            for p in [p for p in some if len(p) > LONG]:
                known.pop(p, None)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        twice = pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNSAFE).to_pylist()
        safe = [not t[:1].isspace() and not w and not any(a in t for a in self.added) for t, w in zip(texts, twice, strict=True)]
        whole = iter(self._ids([t for t, s in zip(texts, safe, strict=True) if not s]))
        cut = pa.array(["\n" + t.replace("\n", " \n") for t, s in zip(texts, safe, strict=True) if s], pa.large_string())
        words = pc.split_pattern(cut, " ")
        coded = words.flatten().dictionary_encode()
        ids = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # in half a microsecond less a piece than to_pylist
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        taken = lists.take(coded.indices)
        every = taken.flatten().to_numpy()
        at = taken.offsets.to_numpy()[words.offsets.to_numpy()].tolist() if len(taken) else [0] * len(words.offsets)
        parts = iter([every[i + 1 : j] for i, j in zip(at[:-1], at[1:], strict=True)])  # without the line break put before the text
        return [next(parts) if s else np.frombuffer(next(whole), "<u4") for s in safe]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def serialized(ids: np.ndarray, end: int) -> bytes:
    ids = np.append(ids, np.uint32(end))
    out = np.empty((4, len(ids)), np.uint8)
    for i in range(4):
        out[i] = ids >> (8 * i)
    return out.tobytes()


def deserialized(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _spread(ids: np.ndarray) -> np.ndarray:
    """A short text's ids, or evenly spaced pieces of a long one's."""
    if len(ids) < SLICES * SLICE:
        return ids
    return np.concatenate([ids[i : i + SLICE] for i in np.linspace(0, len(ids) - SLICE, SLICES).astype(int)])


def train(docs: DataFrame, tokenizer: str, end: int = END, samples: int = SAMPLES, size: int = DICTIONARY) -> bytes:
    """A dictionary from the ids of a bounded sample; empty where zstandard can't train one (too few ids)."""

    def run(batches):
        pieces = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids = pieces.encode(part.column(0).to_pylist())
                yield pa.RecordBatch.from_pydict({"ids": pa.array([serialized(_spread(x), end) for x in ids], pa.binary())})

    # hashes alone are ordered, so no texts are shuffled for it; then at most ``samples`` hashes pass
    rows = _texts(docs).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    last = rows.select("h").orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    sample = rows.where(F.col("h") <= (0 if last is None else last)).dropDuplicates(["h"]).select("text")
    rows = [bytes(r["ids"]) for r in sample.repartition(8).mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, sorted(rows)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> str:
    """Writes the files and gives the dictionary's hash."""
    spark = docs.sparkSession
    data = train(docs, tokenizer, end)
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, data)], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(data)

    def pack(batches):
        """Blocks of a partition, each with the index of its documents."""
        pieces = encoder(tokenizer)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True)
        rows, held, number = [], 0, 0
        for batch in batches:
            for part in portions(batch, 2):
                for doc, ids in zip(part.column(1).to_pylist(), pieces.encode(part.column(2).to_pylist()), strict=True):
                    frame = packer.compress(serialized(ids, end))
                    rows.append((doc, len(ids) + 1, frame))
                    held += len(frame)
                    if held >= BLOCK:
                        yield block(part.column(0)[0].as_py(), number, rows)
                        rows, held, number = [], 0, number + 1
                here = part.column(0)[0].as_py()
        if rows:
            yield block(here, number, rows)

    def block(part, number, rows):
        ids, tokens, frames = zip(*rows, strict=True)
        sizes, tokens = np.fromiter(map(len, frames), np.int64, len(frames)), np.array(tokens, np.int64)
        columns = [pa.array(ids, pa.int64()), *map(pa.array, (np.cumsum(sizes) - sizes, sizes, np.cumsum(tokens) - tokens, tokens))]
        places = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.StructArray.from_arrays(columns, ["doc_id", "offset", "bytes", "before", "n_tokens"]))
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([digest]), pa.array([int(tokens.sum())], pa.int64()), places, pa.array([b"".join(frames)], pa.binary())], ["block", "dictionary_hash", "tokens", "places", "data"])

    order = F.col("doc_id").asc_nulls_first()
    ranged = _texts(docs).repartitionByRange(order, F.xxhash64("text")).sortWithinPartitions(order)
    schema = "block long, dictionary_hash string, tokens long, places array<struct<doc_id:long,offset:long,bytes:long,before:long,n_tokens:long>>, data binary"
    ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(pack, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    # the ids before a block, by prefix sums over partitions and then over a partition's blocks: a row for each block
    heads = blocks.select("block", "tokens", F.shiftright("block", 32).alias("part"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = heads.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(every), F.lit(0)).alias("sooner"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.join(totals, "part").select("block", (F.col("sooner") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("first"))
    index = blocks.select("block", F.explode("places").alias("i")).join(heads, "block")
    index.select("i.doc_id", "block", "i.offset", "i.bytes", (F.col("first") + F.col("i.before")).alias("start"), "i.n_tokens").write.parquet(f"{path}/index")
    heads.write.parquet(f"{path}/heads")
    return digest


def _opened(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["hash"]:
        raise ValueError("the dictionary doesn't match its hash")
    return row["hash"], data


def _decoded(spark: SparkSession, path: str, blocks: DataFrame, each, name: str, sql: str, kind: pa.DataType) -> DataFrame:
    """Decodes blocks where they are read; column ``name`` holds each(ids) of every document. Blocks aren't shuffled."""
    digest, data = _opened(spark, path)
    shared = spark.sparkContext.broadcast(data)

    def run(batches):
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for batch in batches:
            for part in slices(batch, 1):
                (number,), (held,), (blob,) = (part.column(i).to_pylist() for i in (0, 1, 3))
                if held != digest:
                    raise ValueError("a block was written with another dictionary")
                docs, offsets, sizes, before, tokens = part.column(2).flatten().flatten()
                view, out = memoryview(blob), []
                for o, n, count in zip(offsets.to_pylist(), sizes.to_pylist(), tokens.to_pylist(), strict=True):
                    ids = deserialized(opener.decompress(view[o : o + n]))
                    if len(ids) != count:
                        raise ValueError(f"block {number} has a document of {len(ids)} ids, its index {count}")
                    out.append(each(ids))
                yield pa.RecordBatch.from_arrays([docs, pa.array([number] * len(out), pa.int64()), before, tokens, pa.array(out, kind)], ["doc_id", "block", "before", "n_tokens", name])

    decoded = blocks.select("block", "dictionary_hash", "places", "data").mapInArrow(run, f"doc_id long, block long, before long, n_tokens long, {name} {sql}")
    heads = spark.read.parquet(f"{path}/heads")
    return decoded.join(heads, "block").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids."""
    return _decoded(spark, path, spark.read.parquet(f"{path}/blocks"), lambda ids: ids.tolist(), "ids", "array<long>", pa.list_(pa.int64()))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The same for single documents; only their blocks and frames are opened."""
    found = spark.read.parquet(f"{path}/index").where(F.col("doc_id").isin(doc_ids)).select("block").distinct().collect()
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("block").isin([r["block"] for r in found]))
    blocks = blocks.withColumn("places", F.filter("places", lambda p: p["doc_id"].isin(doc_ids)))
    return _decoded(spark, path, blocks, lambda ids: ids.tolist(), "ids", "array<long>", pa.list_(pa.int64()))


def zlib_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files."""
    return _decoded(spark, path, spark.read.parquet(f"{path}/blocks"), zlib_crc, "ids_crc32", "long", pa.int64())
