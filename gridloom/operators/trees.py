"""Scoring of boosted trees given as a JSON dump (one nested node object per tree)."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.arrays import let


def node_table(dump: str) -> pd.DataFrame:
    """Flat nodes (tree, node, feature, threshold, yes, no, missing, leaf, cover) of a dumped ensemble.

    Features are named ``f<number>``; a row goes to ``yes`` when its value is below the threshold.
    """
    rows = []
    for tree, root in enumerate(json.loads(dump)):
        stack = [root]
        while stack:
            node = stack.pop()
            inner = "children" in node
            rows.append({
                "tree": tree, "node": node["nodeid"], "feature": int(str(node["split"]).lstrip("f")) if inner else -1,
                "threshold": float(node["split_condition"]) if inner else np.nan, "yes": node.get("yes", -1),
                "no": node.get("no", -1), "missing": node.get("missing", -1), "leaf": float(node.get("leaf", np.nan)),
                "cover": float(node.get("cover", np.nan)),
            })
            stack.extend(node.get("children", []))
    return pd.DataFrame(rows)


def predict_trees(spark: SparkSession, features: Column, nodes: pd.DataFrame, mode: str = "default", objective: str = "binary:logistic",
                  base_score: float = 0.0, tree_limit: int = 0) -> Column:
    """Score an array of features (NaN or null = missing).

    ``mode``: ``default`` (transformed by the objective), ``margin`` (summed leaves), ``leaf`` (an array with the
    leaf node of each tree) or ``contribution`` (an array with the share of each feature in the margin, the
    expected margin last; needs covers). ``tree_limit`` uses the first trees only; 0 means all. All rows of an Arrow batch walk
    a tree together.
    """
    count = int(nodes["tree"].max()) + 1
    used = count if tree_limit <= 0 else min(tree_limit, count)
    tables = []
    for tree in range(used):
        part = nodes[nodes["tree"] == tree].set_index("node").sort_index()
        size = int(part.index.max()) + 1
        table = {c: np.full(size, -1) for c in ("feature", "yes", "no", "missing")}
        for c in table:
            table[c][part.index] = part[c].to_numpy()
        for c in ("threshold", "leaf"):
            table[c] = np.full(size, np.nan)
            table[c][part.index] = part[c].to_numpy()
        tables.append(table)
    shared = spark.sparkContext.broadcast(tables)

    def leaves(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), used), dtype=np.int64)
        for tree, table in enumerate(shared.value):
            at = out[:, tree]
            while True:
                inner = np.flatnonzero(table["feature"][at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                x = values[inner, table["feature"][node]]
                step = np.where(x < table["threshold"][node], table["yes"][node], table["no"][node])
                at[inner] = np.where(np.isnan(x), table["missing"][node], step)
        return out

    def matrix(column: pa.Array) -> np.ndarray:
        flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))

    if mode == "contribution":
        if nodes["cover"].isna().any():
            raise ValueError("contributions need the cover of every node")
        paths = spark.sparkContext.broadcast([_leaf_paths(nodes[nodes["tree"] == t].set_index("node")) for t in range(used)])

        @F.arrow_udf("array<double>")
        def shares(column: pa.Array) -> pa.Array:
            values = matrix(column)
            width = values.shape[1] + 1
            out = np.zeros((len(values), width))
            out[:, -1] = base_score
            for tree in paths.value:
                _add_contributions(values, tree, out)
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * width)
            return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

        return shares(features)

    if mode == "leaf":

        @F.arrow_udf("array<bigint>")
        def which(column: pa.Array) -> pa.Array:
            found = leaves(matrix(column))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * used)
            return pa.ListArray.from_arrays(ends, pa.array(found.ravel()))

        return which(features)

    @F.arrow_udf("double")
    def margin(column: pa.Array) -> pa.Array:
        at = leaves(matrix(column))
        total = np.full(len(at), float(base_score))
        for t, table in enumerate(shared.value):
            total += table["leaf"][at[:, t]]
        return pa.array(total)

    total = margin(features)
    if mode == "margin" or not objective.endswith(":logistic"):
        return total
    return 1 / (1 + F.exp(-total))


def _leaf_paths(nodes: pd.DataFrame) -> list[tuple[float, dict]]:
    """Each leaf with its value and, per feature on the way to it, the splits passed and the share of rows
    that pass them: feature -> (share, [(threshold, wanted side, side of missing values)])."""
    out = []
    stack = [(0, {})]
    while stack:
        number, passed = stack.pop()
        node = nodes.loc[number]
        if node["feature"] < 0:
            out.append((float(node["leaf"]), passed))
            continue
        feature = int(node["feature"])
        for side in ("yes", "no"):
            child = int(node[side])
            share, splits = passed.get(feature, (1.0, []))
            share *= float(nodes.loc[child, "cover"]) / float(node["cover"])
            split = (float(node["threshold"]), side == "yes", node["missing"] == node["yes"])
            stack.append((child, {**passed, feature: (share, [*splits, split])}))
    return out


def _add_contributions(values: np.ndarray, tree: list[tuple[float, dict]], out: np.ndarray) -> None:
    """Add one tree's Shapley values, where an absent feature splits rows by cover.

    For a leaf only the features on its path matter. The sums over subsets of the other features are the
    coefficients of a product of linear factors, one per feature, computed for all rows together.
    """
    for value, passed in tree:
        names = list(passed)
        shares = [passed[f][0] for f in names]
        hits = []
        for f in names:
            x, hit = values[:, f], np.ones(len(values), dtype=bool)
            for threshold, wants_yes, missing_yes in passed[f][1]:
                goes_yes = np.where(np.isnan(x), missing_yes, x < threshold)
                hit &= goes_yes == wants_yes
            hits.append(hit.astype(float))
        count = len(names)
        for place, f in enumerate(names):
            sizes = [np.ones(len(values))]
            for other in range(count):
                if other != place:
                    stay = [c * shares[other] for c in sizes] + [np.zeros(len(values))]
                    join = [np.zeros(len(values))] + [c * hits[other] for c in sizes]
                    sizes = [a + b for a, b in zip(stay, join, strict=True)]
            weight = sum(c * (math.factorial(k) * math.factorial(count - k - 1) / math.factorial(count)) for k, c in enumerate(sizes))
            out[:, f] += value * (hits[place] - shares[place]) * weight
        out[:, -1] += value * float(np.prod(shares))


def dense_from_sparse(indices: Column, values: Column, width: int) -> Column:
    """A dense array from parallel index and value arrays; absent positions are NaN (missing)."""
    places = F.sequence(F.lit(0), F.lit(width - 1))
    missing = F.lit(float("nan"))
    return let(indices, lambda at: let(values, lambda v: F.transform(
        places, lambda i: F.coalesce(F.get(v, F.array_position(at, i).cast("int") - 1), missing)
    )))
