"""Ordered sums without a single-partition window.

A ladder has one rung per distinct value: how many positives and negatives
stand there, and how many at or above it. The running sums are taken in two
levels, over at most ``RUNG_BINS`` equal-width bins of the value range and then
inside each bin, so no task has to see all distinct values in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNG_BINS = 1024


def ladder(df: DataFrame, groups: list[str], score: Column, truth: Column) -> DataFrame:
    """(groups..., score, pos, neg, tp, fp, all_pos, all_neg); tp and fp count rows at or above ``score``.

    Rows whose score is null or NaN, or whose truth is null, do not count.
    """
    rows = df.select(*groups, score.cast("double").alias("score"), truth.cast("boolean").alias("truth"))
    rows = rows.filter("score is not null and not isnan(score) and truth is not null")
    rungs = rows.groupBy(*groups, "score").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    span = rows.agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    rungs = rungs.crossJoin(F.broadcast(span))  # one row
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300))
    rungs = rungs.withColumn("__bin", F.least(F.floor((F.col("score") - F.col("__lo")) / width * RUNG_BINS), F.lit(RUNG_BINS - 1))).drop("__lo", "__hi")
    bins = rungs.groupBy(*groups, "__bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    every = Window.partitionBy(*groups)
    above = every.orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *groups, "__bin", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
        F.sum("p").over(every).alias("all_pos"), F.sum("n").over(every).alias("all_neg"),
    )
    down = Window.partitionBy(*groups, "__bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = [*groups, "__bin"]
    joined = rungs.join(bins, keys)
    return joined.select(
        *groups, "score", "pos", "neg", (F.col("p_above") + F.sum("pos").over(down)).alias("tp"), (F.col("n_above") + F.sum("neg").over(down)).alias("fp"),
        "all_pos", "all_neg",
    )


def auroc(rungs: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., auroc): chance that a positive outranks a negative, ties half; null if a class is empty."""
    below = F.col("all_neg") - F.col("fp")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    pairs = F.first("all_pos") * F.first("all_neg")
    return rungs.groupBy(*groups).agg(F.try_divide(won, pairs.cast("double")).alias("auroc"))


def average_precision(rungs: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., average_precision): precision summed over the steps of recall; null without positives."""
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return rungs.groupBy(*groups).agg(F.try_divide(F.sum(step), F.first("all_pos").cast("double")).alias("average_precision"))
