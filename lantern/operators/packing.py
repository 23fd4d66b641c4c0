"""Text in chunks of a bounded number of tokens. A token is a run of letters and digits without CJK, one CJK letter, or any other mark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_TOKEN = r"[\p{L}\p{N}&&[^\x{3400}-\x{9fff}]]+|[\x{3400}-\x{9fff}]|[^\s\p{L}\p{N}]"
#: Fixed patterns of lines that open a chunk.
HEADING = r"^(#|第[零一二三四五六七八九十百0-9]+(章|节|部分|条)|[0-9]{1,2}(\.[0-9]{1,2}){0,3}[ 、.]|[（(]?[一二三四五六七八九十0-9]+[)）][、.]?|[一二三四五六七八九十]+[、.]|(风险提示|风险因素|投资建议|盈利预测|主要财务指标|利润表|现金流量表|资产负债表)$)"


def tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_TOKEN))


def heading(c: Column) -> Column:
    return F.startswith(c, F.lit("#")) & (F.length(c) <= 64) | (F.rlike(c, F.lit(HEADING)) & (F.length(c) <= 64) & ~F.rlike(c, F.lit("[。；！？]$")))


def greedy(sizes: list[int], opens: list[bool], limit: int, before: bool) -> list[int]:
    """The chunk of each piece, in order. ``before``: a chunk closes before it would exceed the limit, and where a piece opens one;
    else once it has exceeded it."""
    out, chunk, held, any_yet = [], 0, 0, False
    for size, opening in zip(sizes, opens, strict=True):
        if any_yet and (opening or held + size > limit if before else held > limit):
            chunk, held = chunk + 1, 0
        any_yet = True
        held += size
        out.append(chunk)
    return out


def chunked(docs: DataFrame, id: str, pieces: str, limit: int, before: bool, opens: Column | None = None) -> DataFrame:
    """(id, chunk, n_tokens, text) of an array of pieces: pieces are put together as they are, in order.

    Sizes and headings are worked out by columns; the fold over a document's sizes runs in Arrow batches, on numbers only.
    """
    p = F.col(pieces)
    given = docs.select(id, p.alias("pieces"), F.transform(p, tokens).alias("sizes"), F.transform(p, lambda x: F.lit(False) if opens is None else heading(F.trim(x))).alias("opens"))

    def run(batches):
        for batch in batches:
            sizes, opening = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            chunks = [greedy(s, o, limit, before) for s, o in zip(sizes, opening, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chunks, pa.list_(pa.int32()))], [id, "pieces", "sizes", "chunks"])

    folded = given.where("pieces is not null").mapInArrow(run, f"{id} {docs.schema[id].dataType.simpleString()}, pieces array<string>, sizes array<int>, chunks array<int>")
    rows = folded.select(id, F.posexplode(F.arrays_zip("pieces", "sizes", "chunks")).alias("pos", "x"))
    joined = rows.groupBy(id, F.col("x.chunks").alias("chunk")).agg(F.sum("x.sizes").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("pos", F.col("x.pieces").alias("piece")))).alias("all"))
    return joined.select(id, "chunk", "n_tokens", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("text"))


def delimited(c: Column, delimiters: str = "\n!?;。；！？") -> Column:
    """A text's pieces and the delimiters between them, in turn."""
    return F.split(c, f"(?<=[{delimiters}])|(?=[{delimiters}])")
