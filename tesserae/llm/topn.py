"""The N best rows of every group, however large the group.

Method: a score histogram per group gives a threshold with at least N
different rows at or above it; rows below go, the rest is ranked exactly with
the tie key. Only the ``BROADCAST_GROUPS`` largest groups have a threshold, so
that the table of thresholds has a bound: among millions of groups the others
are small, and without one their rows are ranked as they are. The histogram counts different ids by a 64-bit sketch per bin
(bits set never exceed the ids met), so rows delivered twice can not raise the
threshold and no pass over all rows is needed to remove them first. Ranking
uses dense_rank over (score, id), which Spark cuts to N per group before the
shuffle as well, so a million equal scores in one bin do not meet in one task.

Defined cases: rows with a null in a group column or id, and scores that are
null, NaN or outside the bounds, belong to no ranking; groups with fewer than
N rows are given whole; repeated rows count once; of equal scores the smaller
id comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024
#: Groups that get a threshold, the largest first.
BROADCAST_GROUPS = 50_000
#: Rows per place to give, below which a threshold would spare nothing.
LEAST_ROWS = 8


def group_thresholds(rows: DataFrame, groups: list[str], n: int, low: float, high: float, bins: int = BINS) -> DataFrame:
    """(groups..., floor_bin) of the largest groups whose threshold is above the lowest bin."""
    width = (high - low) / bins
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) AS int))")
    hist = rows.groupBy(*groups, F.least(F.floor((F.col("score") - low) / width), F.lit(bins - 1)).alias("bin")).agg(
        F.bit_count(F.bit_or(bit)).alias("at_least"), F.count("*").alias("rows")
    )
    down = Window.partitionBy(*groups).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = hist.withColumn("met", F.sum("at_least").over(down))
    floors = met.groupBy(*groups).agg(F.max(F.when(F.col("met") >= n, F.col("bin"))).alias("floor_bin"), F.sum("rows").alias("rows"))
    floors = floors.filter((F.col("floor_bin") > 0) & (F.col("rows") > LEAST_ROWS * n))
    return floors.orderBy(F.col("rows").desc(), *groups).limit(BROADCAST_GROUPS).drop("rows")


def top_n(df: DataFrame, groups: list[str], score: str, id_column: str, n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(groups..., rank_no, id, score) of the ``n`` highest scores per group."""
    named = [f"g{i}" for i in range(len(groups))]
    value = df[score].cast("double") + F.lit(0.0)
    rows = df.select(*[df[g].alias(a) for g, a in zip(groups, named)], df[id_column].alias("id"), value.alias("score"))
    rows = rows.filter((F.col("score") >= low) & (F.col("score") <= high) & F.col("id").isNotNull())
    for a in named:
        rows = rows.filter(F.col(a).isNotNull())

    width = (high - low) / BINS
    kept = rows.join(F.broadcast(group_thresholds(rows, named, n, low, high)), named, "left")
    bin_of = F.least(F.floor((F.col("score") - low) / width), F.lit(BINS - 1))
    kept = kept.filter(bin_of >= F.coalesce("floor_bin", F.lit(0))).drop("floor_bin")

    order = Window.partitionBy(*named).orderBy(F.col("score").desc(), F.col("id"))
    ranked = kept.withColumn("rank_no", F.dense_rank().over(order)).filter(F.col("rank_no") <= n).distinct()
    return ranked.select(*[F.col(a).alias(g) for g, a in zip(groups, named)], "rank_no", F.col("id").alias(id_column), F.col("score").alias(score))
