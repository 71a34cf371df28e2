"""Connected regions of a binary map, for maps of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.lookup import checked_lookup
from gridloom.session import cut_lineage

TILE = 256
MAX_EDGES = 500_000


def regions(cells: DataFrame, map_key: str, tile: int = TILE, max_edges: int | None = None) -> DataFrame:
    """Label foreground cells (map, i, j) with ``region``, the smallest cell number of their 4-neighbour region.

    Each tile is labelled on its own (at most ``tile * tile`` cells per group). Labels that touch across a
    tile edge are then merged over the much smaller graph of tile regions: per map in one group while no map has
    more than ``max_edges`` touching pairs, else by an iterated minimum over all tasks. A null map is a map like any other.
    """
    number = "bigint(i) * 4294967296 + bigint(j)"
    base = cells.select(map_key, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))

    def label(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        top, left = i.min(), j.min()
        grid = np.full((i.max() - top + 1, j.max() - left + 1), np.iinfo(np.int64).max, dtype=np.int64)
        solid = np.zeros(grid.shape, dtype=bool)
        grid[i - top, j - left] = i * 4294967296 + j
        solid[i - top, j - left] = True
        far = np.iinfo(np.int64).max
        while True:
            low = grid.copy()
            low[1:] = np.minimum(low[1:], grid[:-1])
            low[:-1] = np.minimum(low[:-1], grid[1:])
            low[:, 1:] = np.minimum(low[:, 1:], grid[:, :-1])
            low[:, :-1] = np.minimum(low[:, :-1], grid[:, 1:])
            low[~solid] = far
            if (low == grid).all():
                break
            grid = low
        return part.assign(region=grid[i - top, j - left]).drop(columns=["_ti", "_tj"])

    tiled = base.withColumn("_ti", F.floor(F.col("i") / tile)).withColumn("_tj", F.floor(F.col("j") / tile))
    kind = base.schema[map_key].dataType.simpleString()
    local = tiled.groupBy(map_key, "_ti", "_tj").applyInPandas(label, f"`{map_key}` {kind}, i long, j long, region long")
    # Joins compare maps as structs, which are equal even where they hold null.
    local = cut_lineage(local.withColumn("_map", F.struct(map_key)))

    def across(axis: str) -> DataFrame:
        edge = local.filter((F.col(axis) % tile == tile - 1)).withColumn(axis, F.col(axis) + 1)
        other = local.filter((F.col(axis) % tile == 0)).withColumnRenamed("region", "other")
        return edge.join(other.drop(map_key), ["_map", "i", "j"]).select("_map", F.col("region").alias("a"), F.col("other").alias("b"))

    touching = cut_lineage(across("i").unionByName(across("j")).distinct())
    if touching.isEmpty():
        return local.drop("_map")
    max_edges = MAX_EDGES if max_edges is None else max_edges
    crowded = touching.groupBy("_map").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_edges)
    merge = _merge_local if crowded.isEmpty() else merge_labels
    roots = merge(touching, "_map").withColumnRenamed("node", "region")
    joined = checked_lookup(local, roots, ["_map", "region"], ["i", "j"])
    return joined.select(map_key, "i", "j", F.coalesce("root", "region").alias("region"))


def _merge_local(edges: DataFrame, key: str) -> DataFrame:
    """Smallest connected node per node, one map per group."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(part[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        root = np.arange(len(names))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
        return pd.DataFrame({key: [part[key].iloc[0]] * len(names), "node": names, "root": names[root]})

    kind = edges.schema[key].dataType.simpleString()
    return edges.groupBy(key).applyInPandas(merge, f"`{key}` {kind}, node long, root long")


def merge_labels(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, root): the smallest node connected to each node of an edge list (key, a, b).

    Each round hooks a node's root to the smallest root among its neighbours and then halves the paths, so the
    number of rounds grows with the logarithm of the longest path.
    """
    both = edges.select(key, F.col("a").alias("node"), F.col("b").alias("peer")).unionByName(
        edges.select(key, F.col("b").alias("node"), F.col("a").alias("peer"))
    )
    both = cut_lineage(both)
    roots = cut_lineage(both.groupBy(key, "node").agg(F.least(F.col("node"), F.min("peer")).alias("root")))
    while True:
        peers = roots.select(key, F.col("node").alias("peer"), F.col("root").alias("peer_root"))
        seen = checked_lookup(both, peers, [key, "peer"], ["node"], how="inner")
        own = checked_lookup(seen, roots, [key, "node"], ["peer"], how="inner")
        # The root of a node learns the smallest root seen by any of its members.
        hooks = own.groupBy(key, F.col("root").alias("node")).agg(F.min("peer_root").alias("low"))
        nodes = roots.join(hooks, [key, "node"], "left").withColumn("root", F.least("root", F.coalesce("low", "root"))).drop("low")
        nodes = cut_lineage(nodes)
        jump = nodes.select(key, F.col("node").alias("root"), F.col("root").alias("next"))
        shorter = checked_lookup(nodes, jump, [key, "root"], ["node"]).select(key, "node", F.coalesce("next", "root").alias("root"))
        shorter = cut_lineage(shorter)
        changed = shorter.join(roots.withColumnRenamed("root", "old"), [key, "node"]).filter(F.col("root") != F.col("old"))
        if changed.isEmpty():
            return shorter
        roots = shorter


def region_boxes(labelled: DataFrame, map_key: str, min_extent: int = 5) -> DataFrame:
    """Bounding box per region, (map, region, i0, j0, i1, j1); boxes spanning no more than ``min_extent`` steps
    in either direction are dropped."""
    found = labelled.groupBy(map_key, "region").agg(
        F.min("i").alias("i0"), F.min("j").alias("j0"), F.max("i").alias("i1"), F.max("j").alias("j1"), F.count(F.lit(1)).alias("cells")
    )
    return found.filter((F.col("i1") - F.col("i0") > min_extent) & (F.col("j1") - F.col("j0") > min_extent))
