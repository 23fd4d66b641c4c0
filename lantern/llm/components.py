"""Connected components by alternating large-star and small-star steps, all on DataFrames.

A node with very many edges would land in one task of a join by node. There can't be many such nodes: those with more than
``1 / HUBS`` of all edges are at most ``2 * HUBS``, so their rows are broadcast and only the rest is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lantern.llm.common import stored

#: A node is a hub if it holds more than 1 / HUBS of the edges, and more than FEW.
HUBS, FEW = 10_000, 100


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def spread_join(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with values, which has one row for each key and in ``held`` how many of the ``total`` rows have it."""
    hub, names = F.col("held") > max(FEW, total // HUBS), [c for c in values.columns if c not in (key, "held")]
    hubs = values.where(hub).select(key, F.struct(*names).alias("hub_values"))
    tried = rows.join(F.broadcast(hubs), key, "left")
    few = tried.where("hub_values is null").select(*rows.columns).join(values.where(~hub).select(key, *names), key).select(*rows.columns, *names)
    return tried.where("hub_values is not null").select(*rows.columns, *(F.col(f"hub_values.{c}").alias(c) for c in names)).unionByName(few)


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("held"))
    return spread_join(both, least, "u", 2 * total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    """u > v on every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held"))
    joined = spread_join(edges, least, "u", total)
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")


def _round(edges: DataFrame, total: int) -> DataFrame:
    return stored(_small(stored(_large(edges, total), "stars"), total), "edges")


def contracted(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 1) -> DataFrame:
    """(u, v), u > v, with the same components after a few rounds: most nodes of a component then share their smallest v."""
    edges = _edges(pairs, a, b)
    for _ in range(rounds):
        edges = _round(edges, edges.count())
    return edges


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node on an edge; the component is its smallest node.

    Each round ends in a written table. Rounds grow with the logarithm of the longest path. Null ends are ignored.
    """
    edges = _edges(pairs, a, b)
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        edges = _round(edges, mark[0])
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
