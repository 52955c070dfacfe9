"""Piecewise scores of masks and generated images, as column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.scalars import clip

#: Weights of the critic's parts and the bends of their curves. Fixed values.
CRITIC_WEIGHTS = {"alignment": 0.32, "coverage": 0.22, "texture": 0.24, "leakage": 0.14, "morphology": 0.08}
TARGET_COVERAGE, MOST_COVERAGE, COVERAGE_FALL = 0.38, 0.92, 0.25
MOST_OUTSIDE, FREE_SHELL, SHELL_FALL = 0.18, 0.35, 0.45


def coverage_score(changed: Column) -> Column:
    """Rises to the target, stays, and falls once nearly all of the mask has changed."""
    over = F.greatest(F.lit(0.0), changed - MOST_COVERAGE)
    return F.when(changed <= TARGET_COVERAGE, F.greatest(F.lit(0.0), changed / TARGET_COVERAGE)).otherwise(F.greatest(F.lit(0.0), 1 - over / COVERAGE_FALL))


def texture_score(l1: Column, slope_l1: Column) -> Column:
    return clip(1 - 8 * l1 - 2.5 * slope_l1, 0.0, 1.0)


def leakage_score(outside: Column, shell: Column) -> Column:
    return clip(0.75 * (1 - outside / MOST_OUTSIDE) + 0.25 * (1 - F.greatest(F.lit(0.0), shell - FREE_SHELL) / SHELL_FALL), 0.0, 1.0)


def alignment_score(a: Column, b: Column) -> Column:
    """Likeness of two vectors: exp of minus 2.4 times their distance per square root of the length."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.exp(-2.4 * F.sqrt(squares) / F.sqrt(F.size(a)))


def critic_score(parts: dict[str, Column], weights: dict[str, float] = CRITIC_WEIGHTS) -> Column:
    """Weighted mean of the parts that are given; weights are scaled to one."""
    total = sum(weights[k] for k in parts)
    out = F.lit(0.0)
    for k in parts:
        out = out + parts[k] * (weights[k] / total)
    return clip(out, 0.0, 1.0)


def area_score(fraction: Column, morphology: Column) -> Column:
    """1 inside the usual range of areas, falling off on both sides."""
    many = morphology == "multi_scuff"
    low, high = F.when(many, 0.025).otherwise(0.004), F.when(many, 0.24).otherwise(0.22)
    return F.when(fraction.between(low, high), 1.0).when(fraction < low, F.greatest(F.lit(0.0), fraction / low)).otherwise(F.greatest(F.lit(0.0), 1 - (fraction - high) / high))


def fragmentation_score(count: Column, morphology: Column) -> Column:
    """Falls with every component beyond what the morphology allows."""
    allowed = F.when(morphology == "multi_scuff", 18).otherwise(8)
    return F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), count - allowed) / 20.0)


def balance_weight(positives: Column, total: Column, most: float) -> Column:
    """How much more a positive cell weighs; 1 without any, never above ``most``."""
    ratio = F.greatest(F.lit(0.0), total - positives) / positives
    return F.when(positives > 0, F.least(F.lit(most), F.greatest(F.lit(1.0), ratio))).otherwise(1.0)
