"""Connected components of a table of edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import drop, join_counted, written


#: Edges in a part of a table, and the fewest parts.
EDGES, PARTS = 1 << 16, 8


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label) for the nodes of edges (a, b) of any one orderable type; label is the component's smallest node.

    Each round gives a node the smallest label among its neighbours, then that label's own label, and writes the
    labels to the shared folder; rounds end when nothing changes.  A node with very many neighbours, and a label of very many nodes,
    are frequent keys: joins know their numbers and leave such rows where they are.  Tables have parts by the number of edges, since a
    round over few edges in very many files costs more than the edges.  Repeated edges and loops change nothing.  No edges: no rows.
    """
    parts = max(PARTS, math.ceil(2 * edges.count() / EDGES))
    stored = lambda df, name: written(df.coalesce(parts), name)
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = both.count()
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    nodes = labels.count()
    for _ in range(rounds):
        near = join_counted(both, labels.withColumnRenamed("node", "b"), ["b"], "degree", total).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "node").select("node", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label")), "steps")
        # every label is a node, so each finds its own label
        far = step.groupBy("label").agg(F.count(F.lit(1)).alias("times")).join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        far = stored(far, "far")
        after = stored(join_counted(step, far, ["label"], "times", nodes).select("node", "degree", "old", F.least("label", "far").alias("label")), "labels")
        drop(labels, step, far)
        labels = after
        if labels.filter("old <> label").isEmpty():
            drop(both)
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
