"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b), the smallest node it is connected with.

    Rounds of "take the smallest label among the neighbours, then the label of that label". Minima are combined before
    the shuffle; a label that many nodes share makes one large key only in a sort-merge join, where it can be split. Each
    round is a written table, so a lost executor repeats one round. Loops and repeated edges do no harm.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("of")).agg(F.min("root").alias("low"))
        first = labels.join(near, labels["node"] == near["of"]).select("node", F.col("root").alias("old"), F.least("root", "low").alias("label"))
        onward = labels.select(F.col("node").alias("at"), F.col("root").alias("next"))
        jumped = first.join(onward, first["label"] == onward["at"]).select("node", "old", F.least("label", "next").alias("root"))
        written = cut_lineage(jumped)
        moved = written.where("root <> old").limit(1).count()
        labels = written.select("node", "root")
        if not moved:
            return labels
