"""Connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that a task reduces to a forest at once.
FOREST = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) of every vertex that is not itself the smallest."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= FOREST:
            v, r = forest(*np.concatenate([f[["a", "b"]].to_numpy(np.int64) for f in held]).T)
            yield pd.DataFrame({"a": r, "b": v})
            held, size = [], 0
    if size:
        v, r = forest(*np.concatenate([f[["a", "b"]].to_numpy(np.int64) for f in held]).T)
        yield pd.DataFrame({"a": r, "b": v})


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  (v, c) for every vertex with an edge: c is the smallest vertex that it reaches.

    Each task first reduces its edges to a forest; then labels fall along edges and
    are short-cut (a label takes its own label) until none changes, a number of
    rounds that grows with the logarithm of the longest path.  Every round is
    written to the shared folder.
    """
    links = materialise(edges.select("a", "b").mapInPandas(_local, "a long, b long").distinct(), "forest")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c")).select("v", F.least("v", "c").alias("c")), "labels")
    while True:
        offered = both.join(labels, both["a"] == labels["v"]).groupBy(F.col("b").alias("v")).agg(F.min("c").alias("o"))
        new = labels.join(offered, "v", "left").select("v", F.least("c", F.coalesce("o", "c")).alias("n"), "c")
        above = labels.select(F.col("v").alias("n"), F.col("c").alias("up"))
        new = new.join(above, "n", "left").select("v", F.least("n", F.coalesce("up", "n")).alias("n"), "c")
        new = materialise(new, "labels")
        if new.where(F.col("n") != F.col("c")).isEmpty():
            return new.select("v", "c")
        labels = new.select("v", F.col("n").alias("c"))
