"""Exact order statistics of groups of any size.

A group's values are cut into bins of equal width on a logarithmic scale, so
that outliers do not put all others into one; counts of the bins tell which
bin holds each wanted rank, and only the rows of these bins are put in order,
equal values as one row. No task sees all values of a group.

Defined cases: null and NaN values count for nothing; a null group is a group;
a group without any value has no row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import cut

#: Bins per group; a window over the counts of one group's bins is one task.
BINS = 1 << 12


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys equal one another."""
    renamed = {k: f"__b{i}" for i, k in enumerate(keys)}
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    return a.join(b.withColumnsRenamed(renamed), same).drop(*renamed.values())


def order_statistics(df: DataFrame, groups: list[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """(groups..., n, at): map from each wanted rank (0 is the least) to its value.

    ``ranks``: the array of wanted ranks as a column of the group's size.
    """
    keys = groups or ["__all"]
    rows = df if groups else df.withColumn("__all", F.lit(0))
    v = F.col(value).cast("double")
    rows = rows.select(*keys, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    scale = lambda x: F.signum(x) * F.log1p(F.abs(x))
    # per group and per bin there are few rows; kept, they save reading the input again for each use
    span = cut(rows.groupBy(*keys).agg(scale(F.min("__v")).alias("__lo"), scale(F.max("__v")).alias("__hi")))
    placed = null_safe_join(rows, span, keys)
    part = (scale(F.col("__v")) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    placed = placed.select(*keys, "__v", F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(BINS - 1), F.floor(part * BINS))).otherwise(0).cast("int").alias("__bin"))

    counts = cut(placed.groupBy(*keys, "__bin").agg(F.count("*").alias("__c")))
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    asked = sizes.select(*keys, "__n", F.explode(F.array_distinct(ranks(F.col("__n")))).alias("__r"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("__before", upto - F.col("__c"))
    hit = null_safe_join(counts, asked, keys).filter((F.col("__r") >= F.col("__before")) & (F.col("__r") < F.col("__before") + F.col("__c"))).drop("__c")
    wanted = hit.select(*keys, "__bin", "__before").distinct()

    kept = null_safe_join(placed, wanted, [*keys, "__bin"]).groupBy(*keys, "__bin", "__before", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    kept = kept.withColumn("__upto", upto).drop("__before")
    found = null_safe_join(kept, hit.drop("__before"), [*keys, "__bin"]).filter((F.col("__r") < F.col("__upto")) & (F.col("__r") >= F.col("__upto") - F.col("__c")))
    out = found.groupBy(*keys).agg(F.first("__n").alias("n"), F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("at"))
    return out.select(*groups, "n", "at")


def exact_quantiles(df: DataFrame, groups: list[str], value: str, parts: list[float]) -> DataFrame:
    """(groups..., n, q): the quantiles at ``parts``, between neighbouring ranks in proportion."""
    # one lambda over all parts: an expression per part would take long to plan for many of them
    listed = F.expr(f"array({', '.join(f'{float(p)!r}D' for p in parts)})")
    place = lambda n, p: (n - 1) * p
    low = lambda n, p: F.floor(place(n, p)).cast("bigint")
    high = lambda n, p: F.ceil(place(n, p)).cast("bigint")
    found = order_statistics(df, groups, value, lambda n: F.flatten(F.transform(listed, lambda p: F.array(low(n, p), high(n, p)))))
    n, at = F.col("n"), F.col("at")

    def quantile(p: Column) -> Column:
        a, b = at[low(n, p)], at[high(n, p)]
        return F.when(a == b, a).otherwise(a + (b - a) * (place(n, p) - low(n, p)))

    return found.select(*groups, "n", F.transform(listed, quantile).alias("q"))
