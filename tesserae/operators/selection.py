"""Selecting candidates: reasons against, scores, capped top-k, arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import clip


def quality_score(visibility: Column, l1: Column, outside: Column, flags: Column) -> Column:
    """Visibility less twice the change of the background, leakage and flags."""
    return visibility - 2 * l1 - 0.10 * F.greatest(F.lit(0.0), outside - 0.05) - 0.05 * flags


def top_k(df: DataFrame, groups: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` first rows per group by score, then tie, with ``place``."""
    if k <= 0:
        return df.withColumn("place", F.lit(0)).limit(0)
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def capped_top_k(df: DataFrame, groups: list[str], score: str, tie: str, special: Column, k: int, fraction: float, repeated: bool = False) -> DataFrame:
    """Top-k per group with at most ``round(k * fraction)`` special rows before all others had their turn.

    Special rows beyond the quota are deferred and only fill what is left. As
    no more than ``k`` rows of either kind can matter, both kinds are cut to
    ``k`` per group before the shuffle of the final ranking. ``repeated`` says
    that rows may stand there several times under one tie value; they share a
    rank in the first cut and are made one after it, so that no shuffle of all
    rows is needed to remove them.
    """
    if k <= 0:
        return df.withColumn("place", F.lit(0)).limit(0)
    quota = round(k * fraction)
    kind = Window.partitionBy(*groups, "special").orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    rank = F.dense_rank() if repeated else F.row_number()
    best = df.withColumn("special", special).withColumn("nth", rank.over(kind)).filter(F.col("nth") <= k)
    if repeated:
        best = best.dropDuplicates([*groups, tie])
    deferred = F.col("special") & (F.col("nth") > quota)
    order = Window.partitionBy(*groups).orderBy(deferred.cast("int"), F.col(score).desc_nulls_last(), F.col(tie))
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("nth")


def reason_histogram(df: DataFrame, column: str) -> DataFrame:
    """How often each reason stands."""
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


def first_best(df: DataFrame, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """One row per key: the highest score, of equal ones the first."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(ordinal))
    return df.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")


def disposition(iou: Column, lower_bound: Column, disagreement: Column) -> Column:
    """hard_mask_ok, soft_mask_only or needs_review."""
    return F.when((lower_bound >= 0.45) & (disagreement <= 0.20), "hard_mask_ok").when(iou >= 0.25, "soft_mask_only").otherwise("needs_review")


def heuristic_prediction(coverage: Column, agreement: Column, disagreement: Column, area: Column) -> dict[str, Column]:
    """Expected IoU, precision, recall and the lower bound, without a trained model."""
    iou = clip(0.10 + 0.48 * coverage + 0.30 * agreement - 0.32 * disagreement - 0.25 * F.greatest(F.lit(0.0), area - 0.20), 0, 1)
    precision = clip(0.15 + 0.55 * coverage + 0.20 * agreement - 0.25 * disagreement, 0, 1)
    recall = clip(0.10 + 0.40 * agreement + 0.30 * F.least(F.lit(1.0), area / 0.08) - 0.20 * disagreement, 0, 1)
    return {"iou": iou, "precision": precision, "recall": recall, "lower_bound": F.greatest(F.lit(0.0), iou - 0.18)}


def arbitration(auroc: Column, aupro: Column, dice: Column, rate: Column, truth: Column, ratio: Column, base: dict[str, Column]) -> dict[str, Column]:
    """Verdict on a mixing ratio against its evaluator's baseline (columns of ``base``)."""
    ranking, base_ranking = 0.45 * auroc + 0.55 * aupro, 0.45 * base["auroc"] + 0.55 * base["aupro"]
    gain = lambda a, b: F.coalesce(a - b >= 0.005, F.lit(False))  # noqa: E731 - none without a baseline
    dice_gain, ranking_gain = gain(dice, base["dice"]), gain(ranking, base_ranking)
    inflated = rate > 1.5 * F.greatest(truth, F.lit(1e-6))
    high = ratio >= 0.5
    verdict = (
        F.when(high & inflated & ~dice_gain, "demote_ratio")
        .when(dice_gain & ranking_gain & ~inflated, "recommended")
        .when(dice_gain | ranking_gain, "candidate")
        .when(high, "demote_ratio")
        .otherwise("candidate")
    )
    return {"utility": 0.45 * ranking + 0.55 * dice, "verdict": verdict}
