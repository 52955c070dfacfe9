"""Images as rows: (id, h, w, values) with an array of cells, row by row.

``map_rasters`` runs a kernel over whole batches of rows where they lie; there
is no shuffle and no row per cell. Rows whose array is null or does not have
h x w cells give no result; NaN cells count as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rasters(df: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, batch: int = 256) -> DataFrame:
    """``kernel(ids, stack)`` -> rows of ``schema``, per batch of images of one size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for (h, w), rows in part.groupby(["h", "w"], sort=False):
                for i in range(0, len(rows), batch):
                    some = rows.iloc[i : i + batch]
                    stack = np.stack(some["values"].to_numpy()).astype(np.float64).reshape(len(some), int(h), int(w))
                    yield kernel(some["id"].to_numpy(), np.nan_to_num(stack))

    fine = "values is not null and h > 0 and w > 0 and size(values) = h * w"
    return df.filter(fine).select("id", "h", "w", "values").mapInPandas(run, schema)


def arrays(ids: np.ndarray, stack: np.ndarray, name: str = "values") -> pd.DataFrame:
    """A stack as rows again."""
    return pd.DataFrame({"id": ids, name: list(stack.reshape(len(stack), -1))})


def cells(df: DataFrame) -> DataFrame:
    """(id, y, x, v): one row per cell, for relational use on small images."""
    long = df.select("id", "w", F.posexplode("values").alias("pos", "v"))
    return long.select("id", F.expr("cast(pos div w as int)").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def vote_fraction(masks: list[Column]) -> Column:
    """Share of masks (arrays of 0 and 1) set in each cell; stays inside the row."""
    total = masks[0]
    for m in masks[1:]:
        total = F.zip_with(total, m, lambda a, b: a + b)
    return F.transform(total, lambda v: v / float(len(masks)))


def soft_level(vote: Column) -> Column:
    """Votes as soft labels: 255 from two thirds, 128 from one third, else 0."""
    return F.transform(vote, lambda v: F.when(v >= 0.67, 255).when(v >= 0.34, 128).otherwise(0))


def soft_entropy(p: Column) -> Column:
    """Mean binary entropy of the cells strictly between 0 and 1; 0 if there are none."""
    inner = F.filter(p, lambda v: (v > 0) & (v < 1))
    each = F.transform(inner, lambda v: -(v * F.log2(v + 1e-6) + (1 - v) * F.log2(1 - v + 1e-6)))
    return F.coalesce(F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, b: a + b), F.size(each).cast("double")), F.lit(0.0))
