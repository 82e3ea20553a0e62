"""Connected components of an edge table (u long, v long), by alternating large and small stars.

Each round is a minimum per node (partial aggregation) and a join on the node; hot centres are split by adaptive
execution. Every round's edges are written to the shared folder. No edges or labels reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, stored


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of a small edge list."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    label = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:  # jump pointers to the roots
            root = new[new]
            if (root == new).all():
                break
            new = root
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars, batch by batch."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.zeros(0, np.int64)
        for batch in batches:
            u, v = spanning(np.r_[u, batch["u"].to_numpy()], np.r_[v, batch["v"].to_numpy()])
            if len(u) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                u = v = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return importable(edges).mapInArrow(work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node with an edge that isn't the smallest of its component; label is the smallest."""
    now = stored(_contract(edges.where("u <> v")).distinct(), "cc-start")
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-low")  # stored: a join right after an aggregate isn't split where it is skewed
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        large = stored(large, "cc-large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low.hint("merge"), "u")
        small = small.select("u", "m").unionAll(small.select(F.col("v").alias("u"), "m")).where("u <> m").select("u", F.col("m").alias("v")).distinct()
        now = stored(small, "cc-round")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()  # one row
        if tuple(state) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = tuple(state)
