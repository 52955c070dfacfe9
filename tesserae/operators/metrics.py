"""Segmentation, calibration and agreement metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.quantiles import exact_quantiles, null_safe_join, order_statistics
from tesserae.session import cut


def confusion(df: DataFrame, groups: list[str], predicted: Column, truth: Column, *more: Column) -> DataFrame:
    """(groups..., tp, fp, fn, tn): counts of cells by prediction and truth."""
    p, t = predicted, truth
    return df.groupBy(*groups).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), *more
    )


def overlap_ratios(guarded: bool = True) -> dict[str, Column]:
    """iou, dice, precision and recall of tp, fp, fn.

    Guarded, an empty denominator counts as one; otherwise the ratio is null.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    over = lambda a, b: a / F.greatest(F.lit(1), b) if guarded else F.try_divide(a.cast("double"), b.cast("double"))
    return {"iou": over(tp, tp + fp + fn), "dice": over(2 * tp, 2 * tp + fp + fn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn)}


#: Bars of the gate: at least, but for the regret, which is at most. Fixed values.
GATE = {"macro_dice": 0.55, "worst_dice": 0.30, "recall": 0.90, "coverage": 0.75, "regret": 0.05}


def gate(row: DataFrame) -> DataFrame:
    """``row`` of measures with ``go``: whether all clear their bars; one that is null does not."""
    tests = [(F.col(c) <= bar) if c == "regret" else (F.col(c) >= bar) for c, bar in GATE.items()]
    return row.withColumn("go", F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)))


def mean_of_known(value: Column) -> Column:
    """Mean that leaves out NaN and null; null if nothing is left."""
    return F.avg(F.when(~F.isnan(value), value))


def worst_quartile(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, least, and mean of the lowest max(1, n // 4) values per group.

    The last of these is found as an order statistic; what lies below it is
    summed, and it counts as often as is left, so ties need no order.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    few = lambda n: F.greatest(F.lit(1), F.floor(n / 4)).cast("bigint")
    edge = order_statistics(rows, group, value, lambda n: F.array(few(n) - 1))
    edge = edge.select(*group, few(F.col("n")).alias("__k"), F.map_values("at")[0].alias("__edge"))
    below = F.col(value) < F.col("__edge")
    both = null_safe_join(rows.select(*group, value), edge, group).groupBy(*group, "__k", "__edge")
    sums = both.agg(F.avg(value).alias("macro"), F.min(value).alias("worst"), F.coalesce(F.sum(F.when(below, F.col(value))), F.lit(0.0)).alias("__s"), F.count_if(below).alias("__b"))
    return sums.select(*group, "macro", "worst", ((F.col("__s") + F.col("__edge") * (F.col("__k") - F.col("__b"))) / F.col("__k")).alias("worst_quartile"))


def robust_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., med, mad): median and median absolute deviation."""
    med = cut(exact_quantiles(df, group, value, [0.5]).select(*group, F.col("q")[0].alias("med")))
    apart = null_safe_join(df.select(*group, value), med, group).withColumn("__d", F.abs(F.col(value) - F.col("med")))
    return exact_quantiles(apart, [*group, "med"], "__d", [0.5]).select(*group, "med", F.col("q")[0].alias("mad"))


def robust_probability(value: Column, med: Column, mad: Column) -> Column:
    """Logistic of the robust z score less 1.5."""
    z = F.least(F.greatest((value - med) / F.greatest(F.lit(1e-6), 1.4826 * mad), F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(-(z - 1.5)))


def calibrated(value: Column, low: Column, high: Column, gamma: float) -> Column:
    """Position between two quantiles, raised to a power; 0 where they coincide."""
    x = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.when(high > low, F.pow(x, F.lit(gamma))).otherwise(0.0)


def fused_log_odds(probabilities: list[Column], reliabilities: list[Column]) -> tuple[Column, Column]:
    """Reliability-weighted mean of log odds as a probability, and the disagreement around it."""
    w = [F.greatest(F.lit(0.05), r) for r in reliabilities]
    total = reduce(lambda a, b: a + b, w)
    p = [F.least(F.greatest(x, F.lit(1e-5)), F.lit(1 - 1e-5)) for x in probabilities]
    logit = reduce(lambda a, b: a + b, [wi * F.ln(pi / (1 - pi)) for wi, pi in zip(w, p)]) / total
    fused = 1 / (1 + F.exp(-logit))
    spread = reduce(lambda a, b: a + b, [wi * (pi - fused) * (pi - fused) for wi, pi in zip(w, p)]) / total
    return fused, F.least(F.lit(1.0), 2 * F.sqrt(spread))


def threshold_candidates(df: DataFrame, score: str, grid: list[float], quantiles: int = 99, margin: float = 1e-6) -> list[float]:
    """Base grid, inner quantiles and just outside the range; rounded, clamped to [0, 1], ascending, once each.

    One row of ``quantiles`` + 2 numbers comes to the driver.
    """
    parts = [i / (quantiles + 1) for i in range(1, quantiles + 1)]
    row = exact_quantiles(df, [], score, [0.0, *parts, 1.0]).first()
    q = row["q"] if row else []
    found = [*grid, *q[1:-1]] + ([q[0] - margin, q[-1] + margin] if q else [])
    return sorted({round(min(1.0, max(0.0, x)), 6) for x in found})


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn) of score >= threshold for every threshold.

    One pass: each row counts towards the interval it falls in, and sums from
    above over the few intervals give the counts. No row meets a threshold.
    """
    step = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(score)))
    marks = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(step.alias("met")).agg(
        F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n")
    )
    listed = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(thresholds)], "met int, threshold double")
    listed = listed.unionByName(df.sparkSession.createDataFrame([(0, None)], "met int, threshold double"))
    laid = F.broadcast(listed).join(marks, "met", "left").fillna(0, ["p", "n"])
    down, every = Window.orderBy(F.col("met").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    laid = laid.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down))
    laid = laid.withColumn("fn", F.sum("p").over(every) - F.col("tp")).withColumn("tn", F.sum("n").over(every) - F.col("fp"))
    return laid.filter("threshold is not null").select("threshold", "tp", "fp", "fn", "tn")


def best_threshold(sweep: DataFrame, weight: float, target: float, least_rate: float, most_rate: float) -> DataFrame:
    """The chosen threshold as one row: feasible first, then objective, Dice, rate, earlier threshold."""
    total = F.greatest(F.lit(1), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    rate = (F.col("tp") + F.col("fp")) / total
    dice = 2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    rows = sweep.withColumn("rate", F.round(rate, 9)).withColumn("dice", F.round(dice, 9))
    rows = rows.withColumn("objective", F.round(F.col("dice") - weight * F.abs(F.col("rate") - target), 9))
    rows = rows.withColumn("satisfied", (F.col("rate") >= least_rate) & (F.col("rate") <= most_rate))
    return rows.orderBy(F.col("satisfied").desc(), F.col("objective").desc(), F.col("dice").desc(), F.round(F.abs(F.col("rate") - target), 9), "threshold").limit(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit number as another one that shows no pattern of it (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: P(X <= k) of a Poisson variable of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
MAX_GROUPS = 10_000


def bootstrap_interval(df: DataFrame, group: str, value: str, tie: str, rounds: int = 1000, seed: int = 17) -> DataFrame:
    """(mean, low, high): 95 % interval of the mean of group means, groups redrawn and within them rows.

    Groups are drawn as often as there are groups, rows by Poisson weights,
    which is how rows are redrawn where they lie spread over many tasks. Both
    follow from hashes, so the result does not depend on partitioning. A task
    sends on one sum per group and round; ``rounds`` sums for each of at most
    ``MAX_GROUPS`` groups reach the driver. A group none of whose rows is drawn
    keeps its plain mean.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), tie).alias("h"))
    step = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    uniform = lambda x: (_mixed(x) >> np.uint64(11)).astype(np.float64) / 2.0**53

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for part in parts:
            for g, own in part.groupby("g"):
                w, s, plain = sums.setdefault(g, (np.zeros(rounds), np.zeros(rounds), np.zeros(2)))
                v, h = own["v"].to_numpy(), own["h"].to_numpy(np.int64).view(np.uint64)
                for i in range(0, len(v), 2048):
                    drawn = np.searchsorted(_POISSON, uniform(h[i : i + 2048, None] + step[None]), side="right")
                    w += drawn.sum(axis=0)
                    s += v[i : i + 2048] @ drawn
                plain += (len(v), v.sum())
        for g, (w, s, plain) in sums.items():
            yield pd.DataFrame({"g": g, "b": np.arange(-1, rounds), "w": np.r_[plain[0], w], "s": np.r_[plain[1], s]})

    kind = dict(rows.dtypes)["g"]
    found = rows.mapInPandas(run, f"g {kind}, b int, w double, s double").groupBy("g", "b").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    # whole groups or none: the bound is checked on groups before their sums are gathered
    n_groups = rows.select("g").distinct().count()
    if n_groups > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    shape = "mean double, low double, high double"
    if not n_groups:
        return spark.createDataFrame([], shape)
    table = found.toPandas().sort_values(["g", "b"])
    w, s = (table[c].to_numpy().reshape(n_groups, rounds + 1) for c in ("w", "s"))
    means = np.where(w[:, 1:] > 0, s[:, 1:] / np.maximum(w[:, 1:], 1), (s[:, :1] / w[:, :1]))
    draw = (uniform(step[:, None] + np.arange(n_groups, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)) * n_groups).astype(int)
    each = means[draw, np.arange(rounds)[:, None]].mean(axis=1)
    return spark.createDataFrame([tuple(float(x) for x in (each.mean(), np.quantile(each, 0.025), np.quantile(each, 0.975)))], shape)


def conformal_bound(df: DataFrame, prediction: str, actual: str, level: float = 0.9) -> DataFrame:
    """(residual): the level's quantile of how far predictions overshoot."""
    over = df.filter(F.col(actual).isNotNull()).withColumn("__over", F.greatest(F.lit(0.0), F.col(prediction) - F.col(actual)))
    return exact_quantiles(over, [], "__over", [level]).select(F.col("q")[0].alias("residual"))


def isotonic_steps(df: DataFrame, prediction: str, actual: str, bins: int = 1000) -> list[tuple[float, float]]:
    """(least prediction, calibrated value) of the rising steps fitted to predictions between 0 and 1.

    Predictions are gathered in ``bins``, a bound for what reaches the driver;
    neighbouring bins that fall are pooled.
    """
    at = F.least(F.lit(bins - 1), F.floor(F.col(prediction) * bins))
    rows = df.filter(F.col(prediction).between(0, 1) & F.col(actual).isNotNull()).groupBy(at.alias("bin"))
    blocks: list[list[float]] = []
    for r in rows.agg(F.avg(actual).alias("y"), F.count("*").alias("n"), F.min(prediction).alias("x")).orderBy("bin").collect():
        blocks.append([r["x"], r["y"], r["n"]])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2]])
    return [(x, y) for x, y, _ in blocks]


def calibrated_bound(df: DataFrame, prediction: str, actual: str, level: float = 0.9) -> DataFrame:
    """``df`` with ``calibrated``, the isotonic value of the prediction, and ``lower``, that less the quantile of its overshoot."""
    steps = isotonic_steps(df, prediction, actual)
    if not steps:
        return df.withColumn("calibrated", F.lit(None).cast("double")).withColumn("lower", F.lit(None).cast("double"))
    met = F.filter(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]), lambda s: s["x"] <= F.col(prediction))
    value = F.coalesce(F.try_element_at(met, F.lit(-1))["y"], F.lit(steps[0][1]))
    rows = df.withColumn("calibrated", F.when(F.col(prediction).between(0, 1), value))
    residual = conformal_bound(rows.filter("calibrated is not null"), "calibrated", actual, level).first()["residual"]
    return rows.withColumn("lower", F.greatest(F.lit(0.0), F.col("calibrated") - F.lit(residual)))
