"""Connected components by randomised contraction.

In every round each node picks, among itself and its neighbours, the one with the smallest hash for that round, and
is merged into it. The expected number of nodes falls by a constant factor, so long paths and large stars alike need a
logarithmic number of rounds. Minima are pre-aggregated in each task; each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.session import materialize


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes by the links a[i]-b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b long, never null) to (node, root): one row per node that has an edge; equal roots are connected.

    Repeated edges and self-links are allowed; without edges the result is empty.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "cc-edges")
    labels = None
    turn = 0
    while labels is None or not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))
        merged = materialize(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("root")), "cc-merge")
        left, right = merged.toDF("a", "ra"), merged.toDF("b", "rb")
        edges = materialize(edges.join(left, "a").join(right, "b").filter("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels = merged
        else:
            labels = materialize(labels.join(merged.toDF("root", "next"), "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")), "cc-labels")
        turn += 1
    return labels
