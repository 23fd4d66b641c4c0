"""Merkle manifest of a table, with a proof for each row, by pointer jumping. DataFrame functions only.

A row is a leaf, the hash of its fields. Of each group the leaves in order are hashed in runs of ``ARITY``, level by level, until one
node, the group's subroot, remains; the subroots in order of their groups are hashed likewise to the root. A node of a tree holds a
segment: what it needs, level by level, to be hashed up to an ancestor, that is the siblings to its left and to its right. At first
the ancestor is the parent. Each self-join of the nodes on their ancestors doubles the distance and puts the ancestor's segment
behind the node's own, so after the logarithm of the height all reach the top. Leaves, seven eighths of all nodes, jump last: a run
of them takes the finished segment of its common parent, and a subroot's finished segment goes to all leaves of its group.

Order is by range: rows are dealt to partitions by (group, order, leaf), and places come from the partitions' counts, so neither a
large group nor a hot one meets in one task. In a jump over ``d`` levels an ancestor has up to 8**d nodes below it; it is
given once to each 64 of them. Groups with very many rows are joined by broadcast (``spread_join``), the others by a shuffle.

Any field may be null and counts as ``-``. A null group is a group of its own, the first; a null order comes first. Rows equal in group
and order stand by their leaves; rows equal in all fields are leaves of their own. A group of one row has its leaf as subroot, and one
subroot alone is the root. An empty table has no rows and no root. Texts of any length are hashed whole. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.llm.common import stored
from lantern.llm.components import spread_join

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that get one copy of an ancestor: 8**2.
BLOCK = 2


def digest(*values: Column) -> Column:
    """sha256 over all values, as binary."""
    return F.unhex(F.sha2(F.concat(*values), 256))


def leaf(*values: Column) -> Column:
    """A row's hash over its fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def as_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def fold(start: Column, path: Column) -> Column:
    """The root, as text, that a leaf's digest and its path lead to."""
    return F.aggregate(path, as_text(start), lambda h, s: F.sha2(F.concat(as_text(s["left"]), h, as_text(s["right"])), 256))


def proof_digest(path: Column) -> Column:
    """One hash, as text, over all siblings of a path in order."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda h, s: F.concat(h, as_text(s["left"]), as_text(s["right"]))), 256)


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with place: their number from 0 in the order of ``keys``, nulls first. A written table."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sooner = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = dealt.groupBy("part").agg(F.count("*").alias("held")).select("part", F.coalesce(F.sum("held").over(sooner), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return stored(dealt.join(before, "part").withColumn("place", (F.col("before") + inside - 1).cast("long")).drop("part", "before"), "numbered")


def _joined(run: Column) -> Column:
    """The digests of a run, or of a part of it, one after the other."""
    return F.aggregate(run, F.unhex(F.lit("")), lambda a, m: F.concat(a, m["digest"]))


def _runs(nodes: DataFrame, *kept: str) -> DataFrame:
    """One row for each ``ARITY`` nodes of a level: tree, idx (the parent's), n (nodes of the level) and run."""
    member = F.struct("idx", "digest", *kept)
    runs = nodes.groupBy("tree", F.shiftright("idx", 3).alias("up")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("run"))
    return runs.select("tree", F.col("up").alias("idx"), "n", "run")


def _parents(runs: DataFrame) -> DataFrame:
    return runs.select("tree", "idx", digest(as_text(_joined(F.col("run")))).alias("digest"), F.shiftright(F.col("n") + ARITY - 1, 3).alias("n"))


def _members(runs: DataFrame, *more: Column) -> DataFrame:
    """The nodes of the runs with their segment to the parent: left, right."""
    each = runs.select("*", F.posexplode("run").alias("at", "node"))
    segment = F.struct(_joined(F.slice("run", F.lit(1), F.col("at"))).alias("left"), _joined(F.slice("run", F.col("at") + 2, F.lit(ARITY))).alias("right"))
    return each.select("tree", F.col("node.idx").alias("idx"), segment.alias("segment"), *more)


def _jump(nodes: DataFrame, d: int) -> DataFrame:
    """Nodes whose segment reaches ``d`` levels, or the top, with segments twice as long.

    nodes: tree, level, idx, path, left (the nodes that are left at the level reached; 1 at the top).
    """
    block = min(d, BLOCK)
    copies = 8 ** (d - block)
    below = F.explode(F.sequence(F.col("idx") * copies, F.col("idx") * copies + copies - 1))
    above = nodes.where(F.col("level") > d).select("tree", (F.col("level") - d).alias("level"), below.alias("block"), F.col("path").alias("upper"), F.col("left").alias("upper_left"))
    open_ = nodes.where("left > 1").withColumn("block", F.shiftright("idx", 3 * block))
    grown = open_.join(above, ["tree", "level", "block"]).select("tree", "level", "idx", F.concat("path", "upper").alias("path"), F.col("upper_left").alias("left"))
    return nodes.where("left = 1").unionByName(grown)


def _tree(leaves: DataFrame, most: int, *kept: str) -> tuple[DataFrame, DataFrame]:
    """(tree, idx, digest, kept, path) of all leaves, and (tree, digest) of the tops.

    leaves: tree, idx (from 0 without gaps), digest, n (leaves of its tree) and columns to keep. most: the largest n.
    """
    runs = stored(_runs(leaves, *kept), "runs")
    tops, nodes, level, held = runs.where("n = 1").select("tree", F.col("run")[0]["digest"].alias("digest")), None, 1, most
    current = _parents(runs.where("n > 1"))
    while held > 1:
        held = -(-held // ARITY)
        current = stored(current, "nodes")
        tops = tops.unionByName(current.where("n = 1").select("tree", "digest"))
        if held > 1:
            upper = stored(_runs(current.where("n > 1")), "runs")
            left = F.shiftright(F.col("n") + ARITY - 1, 3).alias("left")
            part = _members(upper, left, F.lit(level).alias("level")).select("tree", "level", "idx", F.array("segment").alias("path"), "left")
            nodes = part if nodes is None else nodes.unionByName(part)
            current = _parents(upper)
        level += 1
    distance = 1
    while nodes is not None and distance < level - 2:
        nodes = stored(_jump(stored(nodes, "segments") if distance == 1 else nodes, distance), "segments")
        distance *= 2
    if nodes is not None:
        runs = runs.join(nodes.where("level = 1").select("tree", "idx", "path"), ["tree", "idx"], "left")
    else:
        runs = runs.withColumn("path", F.lit(None).cast("array<struct<left:binary,right:binary>>"))
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    path = F.when(F.col("n") == 1, none).otherwise(F.concat(F.array("segment"), F.coalesce("path", none)))
    out = _members(runs, F.col("node"), F.col("path"), F.col("n"))
    return out.select("tree", "idx", "node.digest", *(f"node.{c}" for c in kept), path.alias("path")), tops


def manifest(leaves: DataFrame, group: str, order: str, *kept: str) -> tuple[DataFrame, str | None]:
    """(rows, root): rows holds ``order``, leaf, ``kept``, subroot (binary) and path (from leaf to root) of each row; root is text.

    leaves: the columns ``group``, ``order``, leaf (binary, see ``leaf``) and ``kept``.
    """
    rows = leaves.select(F.col(group).alias("grp"), F.col(order).alias("ord"), F.col("leaf").alias("digest"), F.struct(*(F.col(k) for k in kept)).alias("kept") if kept else F.lit(0).alias("kept"))
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    rows = _numbered(rows, "grp", "ord", "digest", "tie").select("grp", "place", "ord", "digest", "kept")
    groups = _numbered(rows.groupBy("grp").agg(F.min("place").alias("first"), F.count("*").alias("held")), "grp").withColumnRenamed("place", "tree")
    total, trees, most = groups.agg(F.sum("held"), F.count("*"), F.max("held")).first()
    key = F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("-"))
    named = groups.select(key.alias("key"), "tree", "first", F.col("held").alias("n"), "held")
    placed = spread_join(rows.withColumn("key", key), named, "key", total or 0)
    placed = placed.select("tree", (F.col("place") - F.col("first")).alias("idx"), "digest", "n", "ord", "kept")
    proofs, tops = _tree(placed, most or 0, "ord", "kept")
    subroots = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(trees).cast("long").alias("n"))
    upper, top = _tree(subroots, trees)
    found = top.first()
    root = found["digest"].hex() if found else None
    values = upper.select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper")).join(groups.select("tree", "held"), "tree")
    out = spread_join(proofs, stored(values, "subroots"), "tree", total or 0)
    extra = [F.col(f"kept.{k}").alias(k) for k in kept]
    return out.select(F.col("ord").alias(order), F.col("digest").alias("leaf"), *extra, "subroot", F.concat("path", "upper").alias("path")), root
