"""Connected components of an undirected edge list (columns a and b, longs), labelled by their least member."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.checkpoints import cut

#: Up to so many edges one task labels them all in memory; more are contracted by joins. The labels are the same.
LOCAL_EDGES = 3_000_000


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of the vertices 0 to n-1, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        live = low != high
        if not live.any():
            break
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, root) of every vertex that has an edge."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if edges.count() <= local_edges:

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, at = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
            return pd.DataFrame({"id": ids, "root": ids[labels(at[: len(pdf)], at[len(pdf) :], len(ids))]})

        return edges.repartition(1).groupBy((F.col("a") * 0).alias("__all")).applyInPandas(one, "id long, root long")
    state = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("root"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
    return both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "w")
    moved = edges.join(least, F.col("b") == F.col("w"))
    return moved.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), F.col("w").alias("b"))).distinct()
