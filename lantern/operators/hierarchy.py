"""Ancestors in hierarchies of any depth, by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lantern.sources.shared import written


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, depth, root, path, cyclic): path goes from the parent to the root; of a node on a cycle, or below one, only cyclic is set.

    A null parent, or one that isn't a child itself, is the end. Each round joins nodes with what their last known ancestor knows, so
    the known distance doubles; rounds are the logarithm of the longest chain. Children are distinct; null children are dropped.
    """
    known = edges.where(F.col(child).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("up"))
    path = F.when(F.col("up").isNull(), F.array().cast(f"array<{dict(known.dtypes)['up']}>")).otherwise(F.array("up"))
    live, ended = written(known.select("node", path.alias("path"), "up", F.lit(False).alias("cyclic")), "edges"), []
    while True:
        # those at their end are only looked up: all of them have the same null for a key
        ended.append(live.where("up is null or cyclic"))
        live = live.where("up is not null and not cyclic")
        if not live.limit(1).count():
            break
        every = reduce(DataFrame.unionByName, ended, live)
        above = every.select(F.col("node").alias("up"), F.col("path").alias("more"), F.col("up").alias("next"), F.col("cyclic").alias("above_cyclic"))
        joined = live.join(above, "up", "left")
        path = F.concat("path", F.coalesce("more", F.array().cast(dict(live.dtypes)["path"])))
        cyclic = F.col("cyclic") | F.coalesce("above_cyclic", F.lit(False)) | F.array_contains(path, F.col("node")) | (F.size(F.array_distinct(path)) < F.size(path))
        live = written(joined.select("node", F.when(~cyclic, path).otherwise(F.slice(path, 1, 0)).alias("path"), F.when(~cyclic, F.col("next")).alias("up"), cyclic.alias("cyclic")), "paths")
    every = reduce(DataFrame.unionByName, ended)
    known = F.when(~F.col("cyclic"), F.size("path").cast("long"))
    root = F.when(~F.col("cyclic"), F.when(F.size("path") > 0, F.try_element_at("path", F.lit(-1))).otherwise(F.col("node")))
    return every.select(F.col("node").alias(child), known.alias("depth"), root.alias("root"), F.when(~F.col("cyclic"), F.col("path")).alias("path"), "cyclic")
