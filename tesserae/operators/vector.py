"""Nearest neighbours by brute force over vectors, in blocks.

Both sides are laid out in blocks of a bounded number of vectors. Every block
of targets meets every block of the memory in one task and leaves the best of
it; these are then merged. The driver only counts. Vectors of any number are
handled: they only take more blocks, and no pair of vectors is ever a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of each side that meet in one task, about.
BLOCK_VECTORS = 20_000
_FOUND = "id bigint, neighbour bigint, distance double"


def nearest(targets: DataFrame, memory: DataFrame, k: int, metric: str = "cosine", not_itself: bool = False) -> DataFrame:
    """(id, neighbour, distance, nth): the ``k`` nearest memory vectors of every target, smaller id first on ties.

    Both sides are (id, vector). ``cosine`` is 1 - dot product (unit vectors),
    ``euclid`` the distance with negative rounding cut off.
    """
    spark = targets.sparkSession
    blocks = [max(1, -(-side.count() // BLOCK_VECTORS)) for side in (targets, memory)]
    # small sides are still spread over the cores: targets in as many blocks as there are
    blocks[0] = max(blocks[0], spark.sparkContext.defaultParallelism // blocks[1])
    own = [F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") for n in blocks]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
    keys = ["block_t", "block_m"]
    left = targets.select("id", "vector", own[0].alias("block_t")).select("*", every[1].alias("block_m")).groupBy(*keys)
    right = memory.select("id", "vector", own[1].alias("block_m")).select("*", every[0].alias("block_t")).groupBy(*keys)
    search = lambda a, b: _search(a, b, k, metric, not_itself)
    found = left.cogroup(right).applyInPandas(search, _FOUND)
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def _search(targets: pd.DataFrame, memory: pd.DataFrame, k: int, metric: str, not_itself: bool) -> pd.DataFrame:
    parts = [pd.DataFrame({"id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "distance": np.zeros(0)})]
    if len(targets) and len(memory):
        memory = memory.sort_values("id", ignore_index=True)
        known, m = memory["id"].to_numpy(), np.stack(memory["vector"].to_numpy()).astype(np.float64)
        squares = (m * m).sum(axis=1)
        for i in range(0, len(targets), 1000):
            rows = targets.iloc[i : i + 1000]
            x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
            dot = x @ m.T
            d = 1 - dot if metric == "cosine" else np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + squares - 2 * dot, 0))
            own = rows["id"].to_numpy()
            if not_itself:
                d[own[:, None] == known] = np.inf
            take = min(k, d.shape[1])
            edge = np.partition(d, take - 1, axis=1)[:, take - 1 : take]
            r, c = np.nonzero(d <= edge)  # ties at the edge included, so that the smaller id can win
            keep = np.isfinite(d[r, c])
            parts.append(pd.DataFrame({"id": own[r[keep]], "neighbour": known[c[keep]], "distance": d[r[keep], c[keep]]}))
    return pd.concat(parts, ignore_index=True)


def mutual_nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): pairs that are each other's nearest by cosine."""
    there = nearest(a, b, 1).select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    back = nearest(b, a, 1).select(F.col("id").alias("b"), F.col("neighbour").alias("a"))
    return there.join(back, ["a", "b"])
