"""Connected components of an edge table, by Spark joins, or by one task where there are few; nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.session import stage

#: Edges that one task labels by itself (8 MB, and some 50 MB while it does).
FEW = 1 << 19


def _labels(batches):
    """(node, comp) of all edges at once: roots hook to the smallest root that they touch, then chains are cut short."""
    edges = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    nodes, at = np.unique(np.concatenate([edges.column(c).to_numpy() for c in "ab"]), return_inverse=True)
    a, b = at[:edges.num_rows], at[edges.num_rows:]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == top).all():
            break
        top = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], names=["node", "comp"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b, numbers); comp is the smallest node of its component.

    Few edges are labelled by one task. Of more, every round a node takes the smallest label
    among itself and its neighbours, and then the label of that label, so chains shorten by
    halves. Each round is a written table, and the loop ends when no label changes.
    """
    edges = stage(edges.select("a", "b"), "cc-links")
    if edges.count() <= FEW:
        return stage(edges.repartition(1).mapInArrow(_labels, "node long, comp long"), "cc")
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "cc")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near")))
        hop = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        new = stage(hop.join(up, hop.comp == up.up).select("node", "old", F.least("comp", "top").alias("comp")), "cc")
        if new.where("comp <> old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
