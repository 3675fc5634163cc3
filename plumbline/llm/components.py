"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

EDGE = "src long, dst long"


def roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and the smallest node that each can reach over them."""
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """The edges of one partition as stars around the smallest nodes."""
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if held:
        edges = pa.concat_tables(held)
        nodes, root = roots(edges["src"].to_numpy(), edges["dst"].to_numpy())
        leaf = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(root[leaf])], ["src", "dst"])


def connected_components(edges: DataFrame, most_rounds: int = 60, at_once: int = 100_000) -> DataFrame:
    """node, component (smallest node of the same component) for every node of an edge (src, dst: long).

    Each partition first contracts its own edges to stars. If at most ``at_once``
    edges are left, which is counted, one task contracts them. Else large-star and
    small-star rounds alternate until nothing changes: every node's neighbours
    that are greater (or not) are linked to its smallest neighbour. Both rounds
    need only a minimum per node and a join back to the edges, so that a node with
    very many neighbours is never gathered in one task; the minima are written
    first, so that both sides of the join are plain exchanges that AQE can split.
    """
    now = materialise(edges.select("src", "dst").where("src <> dst").mapInArrow(_contract, EDGE).distinct(), "components")
    if now.count() <= at_once:
        now, most_rounds = materialise(now.repartition(1).mapInArrow(_contract, EDGE), "components"), 0
    before = None
    for _ in range(most_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("least"))
        least = materialise(least, "components-least")
        large = both.where("dst > src").join(least, F.col("src") == F.col("node")).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        large = materialise(large.where("src <> dst").distinct(), "components-large")
        # src > dst now holds in every edge
        low = materialise(large.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")), "components-least")
        small = large.join(low, F.col("src") == F.col("node")).select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst")
        now = materialise(small.unionByName(low.select(F.col("node").alias("src"), F.col("least").alias("dst"))).distinct(), "components")
    else:
        if most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
