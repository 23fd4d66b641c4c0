"""Pairs of documents: compared with a hot side streamed, found in blocks, and joined to components.

A document that very many others are compared with is given once to each ``GROUP`` of them; the others stream past it. So neither
its text nor its sketch is carried once for each pair, and no task holds all that a document is compared with.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lantern.llm.common import slices, stored
from lantern.llm.components import components, contracted, spread_join

GROUP = 256


def row_key():
    """128 bits of doc_id and text: rows equal in both are copies, other rows documents of their own."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")))


def compared(pairs: DataFrame, values: DataFrame, prepare: Callable, met: Callable, step: int = 32, key: pa.DataType | None = None) -> DataFrame:
    """(a, b, met) of the pairs (a, b) for which ``met(a's, b's)`` isn't None.

    values: key, value (binary, or an array of longs), one row for each key. ``prepare`` makes of a value what ``met`` takes. Pairs are
    distinct. Rows come to a task by (a, salt), a's own value first; one prepared value is held at a time. ``key`` is the keys' type, binary
    if not given.
    """
    key = key or pa.binary()
    name = "long" if pa.types.is_int64(key) else "binary"
    total = pairs.count()
    held = pairs.groupBy("a").agg(F.count("*").alias("held"))
    held = held.withColumn("salts", F.ceil(F.col("held") / GROUP).cast("int"))
    salted = spread_join(pairs.select("a", "b"), held, "a", total).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    others = salted.join(values.withColumnRenamed("key", "b"), "b").select("a", "salt", "b", "value")
    own = held.join(values.withColumnRenamed("key", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast(name).alias("b"), "value")
    dealt = others.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        of, mine = None, None
        for batch in batches:
            for part in slices(batch, step):
                a, salt, b, value = (part.column(i) for i in range(4))
                if pa.types.is_list(value.type):
                    ends, flat = value.offsets.to_numpy(), value.values.to_numpy(zero_copy_only=False)
                    each = [flat[ends[i] : ends[i + 1]] for i in range(len(value))]
                else:
                    each = value.to_pylist()
                found = []
                for x, s, y, v in zip(a.to_pylist(), salt.to_pylist(), b.to_pylist(), each, strict=True):
                    if y is None:
                        of, mine = (x, s), prepare(v)
                    elif of == (x, s) and (m := met(mine, prepare(v))) is not None:
                        found.append((x, y, m))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((key, key, pa.int64()))], ["a", "b", "met"])

    return dealt.mapInArrow(run, f"a {name}, b {name}, met long")


def overlap(num: int, den: int) -> Callable:
    """The size of the overlap of two sorted sets that link: den * overlap >= num * union."""

    def met(x: np.ndarray, y: np.ndarray):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both if den * both >= num * (len(x) + len(y) - both) else None

    return met


def blocked(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """rows with the leader (``lead``) and the size (``held``) of their block, if it has two rows and more. leaders: block, lead, held.

    The other side of a hot block's rows is one small row, so Spark splits them over tasks as it does any skewed join.
    """
    return rows.join(leaders.where("held > 1").select("block", "lead", "held"), "block")


def star(blocks: DataFrame, sketches: DataFrame, fits: str, near: str) -> DataFrame:
    """(a, b): rows of blocks with their leaders. fits: on na, nb and pa, pb; near: on the columns of sketches as sa, sb."""
    pairs = blocks.where("key <> lead.key").selectExpr("lead.key a", "lead.n na", "lead.pos pa", "key b", "n nb", "pos pb").where(fits)
    pairs = stored(pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")), "pairs")
    side = lambda k: sketches.select(F.col("key").alias(k), F.col("sketch").alias(f"s{k}"))
    held = pairs.groupBy("a").agg(F.count("*").alias("held"))  # a leader may have very many followers
    pairs = spread_join(pairs, side("a").join(held, "a"), "a", pairs.count())
    return pairs.join(side("b"), "b").where(near).select("a", "b")


def others(blocks: DataFrame, sketches: DataFrame, linked: DataFrame, fits: str, near: str) -> tuple[DataFrame, DataFrame]:
    """((a, b), edges): the pairs of blocks without their leaders that the links with leaders don't connect; edges that have their components.

    Rows that links connect to their leader needn't be compared with each other. A block's other rows meet all of its rows under
    the conditions, a salt of the block at a time. If sketches has a column ``blocks``, an array of all blocks of the key, a pair meets
    only in the smallest block that both are in.
    """
    many = blocks.where("held > 2 and key <> lead.key").select("block", "key", "n", "pos", F.col("lead.key").alias("leader"))
    # rows of one label are connected; that not all connected ones have one label only makes more pairs
    nearer = contracted(linked)
    least = nearer.groupBy("u").agg(F.min("v").alias("v"))
    labels = stored(least.unionByName(least.select(F.col("v").alias("u"), "v").distinct().join(least.select("u"), "u", "left_anti")), "labels")
    label = labels.select(F.col("u").alias("key"), F.col("v").alias("label"))
    leaders = many.groupBy("leader").agg(F.count("*").alias("held")).join(labels.select(F.col("u").alias("leader"), F.col("v").alias("lead_label")), "leader", "left")
    placed = many.join(label, "key", "left")
    placed = spread_join(placed, leaders.withColumn("lead_label", F.coalesce("lead_label", "leader")), "leader", many.count())
    own = F.coalesce("label", "key")
    placed = stored(placed.select("block", "key", "n", "pos", own.alias("label"), (own == F.col("lead_label")).alias("joined")), "placed")
    open_ = placed.groupBy("block").agg(F.count_if(~F.col("joined")).alias("open"), F.count("*").alias("held")).where("open > 0")
    open_ = stored(open_.withColumn("salts", F.ceil(F.col("open") / GROUP).cast("int")), "open")
    meeting = stored(spread_join(placed, open_.select("block", "salts", "held"), "block", placed.count()).join(sketches, "key"), "meeting")
    once = "blocks" in sketches.columns
    x = meeting.where("not joined").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    x = x.selectExpr("block", "salt", "key x", "n na", "pos pa", "sketch sa", "label lx", *["blocks ba"] * once)
    y = meeting.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    y = y.selectExpr("block g", "s", "key y", "n nb", "pos pb", "sketch sb", "label ly", "joined", *["blocks bb"] * once)
    met = (F.col("block") == F.col("g")) & (F.col("salt") == F.col("s")) & (F.col("lx") != F.col("ly")) & (F.col("joined") | (F.col("x") < F.col("y")))
    met = met & F.expr(fits) & F.expr(near)
    rest = x.join(y, met & (F.array_min(F.array_intersect("ba", "bb")) == F.col("block")) if once else met)
    return rest.selectExpr("least(x, y) a", "greatest(x, y) b").distinct(), nearer.select(F.col("u").alias("a"), F.col("v").alias("b"))


def labelled(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """reps (print, n, rep, first) with component_id, the smallest doc_id that links reach."""
    labels = stored(components(edges), "labels")
    least = labels.join(reps, F.col("node") == F.col("rep")).groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("held"))
    labels = spread_join(labels, least, "component", labels.count())
    return reps.join(labels, F.col("rep") == F.col("node"), "left").select("print", "n", "rep", F.coalesce("least", "first").alias("component_id"))
