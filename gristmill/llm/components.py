"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import column, drop_path, write_table

#: Links of which one task keeps a spanning forest.
FOREST = 1 << 19


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links a spanning forest of them needs, the first that joins two trees each."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    keep = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
        keep.append(x != y)
    return np.asarray(keep, bool)


def _forest(batches):
    """A spanning forest of a task's links, both ways round."""
    held = [(column(b, "u").to_numpy(), column(b, "v").to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = map(np.concatenate, zip(*held, strict=True))
        keep = spanning(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u[keep], v[keep]])), pa.array(np.concatenate([v[keep], u[keep]]))], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each linked node reaches. Unlinked nodes are absent.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, and ends when nothing changes; a round is a written table, so lineage stays short and a
    lost executor costs one round. Nodes of many links are handled by partial aggregates. First the links
    are dealt to tasks, as few as can hold them, whose spanning forests say as much: however many
    links a large group has, a task leaves fewer than it has nodes.
    """
    given = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = given.repartition(max(2, -(-given.count() // FOREST))).mapInArrow(_forest, "u long, v long")
    edges, edge_path = write_table(both.distinct(), "links")
    labels, path = write_table(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("seen"))
        low = labels.join(near, "node").select("node", F.least("component", "seen").alias("low"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("above"))
        new, new_path = write_table(low.join(up, "low", "left").select("node", F.least("low", "above").alias("component"), (F.least("low", "above") != F.col("was")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        drop_path(links.sparkSession, path)
        labels, path = new.drop("moved"), new_path
        if not moved:
            drop_path(links.sparkSession, edge_path)
            return labels
