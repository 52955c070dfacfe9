"""Joins, deduplication, sampling and mixing with stated rules for ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import cut, shuffle_width


def once(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """Each record once, however often it was delivered: the earliest delivery.

    Only ``columns`` are kept, so the shuffle carries no more than is used.
    """
    kept = F.min_by(F.struct(*[F.col(c) for c in columns]), F.struct(F.col("ingested_at").isNull(), "ingested_at"))
    return df.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(kept.alias("__r")).select(id_column, "__r.*")


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key, the one with the greatest ordinal."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("__r")).select(*keys, "__r.*")


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key, the one with the least ordinal."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("__r")).select(*keys, "__r.*")


def strict_lookup(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails the query if a row has no reference."""
    marked = df.join(reference.withColumn("__there", F.lit(True)), keys, "left")
    fine = F.assert_true(F.col("__there").isNotNull(), F.lit("a row has no reference"))
    return marked.withColumn("__ok", fine).filter("__ok is null").drop("__there", "__ok")


def priority_lookup(df: DataFrame, levels: list[tuple[list[str], DataFrame]], value: str, default: Column) -> DataFrame:
    """``df`` with ``value`` from the first level that knows the row's keys.

    Each level is (key columns, dimension with these keys and ``value``).
    """
    found = []
    for i, (keys, dim) in enumerate(levels):
        df = df.join(dim.select(*keys, F.col(value).alias(f"__v{i}")), keys, "left")
        found.append(F.col(f"__v{i}"))
    return df.withColumn(value, F.coalesce(*found, default)).drop(*[f"__v{i}" for i in range(len(levels))])


def cyclic_pairs(left: DataFrame, right: DataFrame, keys: list[str], seed: Column, right_order: str, right_columns: list[str]) -> DataFrame:
    """Each left row with the reference ``seed mod n`` of its key's references in order."""
    size = Window.partitionBy(*keys)
    numbered = right.select(*keys, *right_columns, (F.row_number().over(size.orderBy(right_order)) - 1).alias("__nth"), F.count("*").over(size).alias("__n"))
    sizes = right.groupBy(*keys).agg(F.count("*").alias("__n"))
    picked = left.join(sizes, keys).withColumn("__nth", F.pmod(seed, F.col("__n"))).drop("__n")
    return picked.join(numbered.drop("__n"), [*keys, "__nth"]).drop("__nth")


def carried_and_missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rerun plan: rows that are done are carried over, the others have to be computed."""
    done = existing.select(*keys).distinct()
    carried = wanted.join(done, keys, "left_semi").withColumn("action", F.lit("carry"))
    return carried.unionByName(wanted.join(done, keys, "left_anti").withColumn("action", F.lit("compute")))


def hash_split(df: DataFrame, group: list[str], identity: str, seed: str, n_first: int) -> DataFrame:
    """``split``: the ``n_first`` rows of each group by hash order adapt, the rest is held out.

    Only the chosen rows are ranked, cut per group before the shuffle; the
    others are never put in order. ``identity`` tells the rows of a group apart.
    """
    point = F.sha2(F.concat_ws("|", F.lit(seed), *group, F.col(identity).cast("string")), 256)
    order = Window.partitionBy(*group).orderBy("__h", identity)
    chosen = df.select(*group, identity).withColumn("__h", point).withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= n_first)
    keys = [*group, identity]
    marked = df.join(chosen.select(*keys, F.lit("adaptation").alias("split")), keys, "left")
    return marked.withColumn("split", F.coalesce("split", F.lit("held_out")))


def ratio_mix(real: DataFrame, synthetic: DataFrame, order: str, ratio: float) -> DataFrame:
    """All real rows and so many synthetic ones, repeated in turn, that they make up ``ratio``.

    Counts of both sides come to the driver; at ratio 0 only real rows, at 1
    or more every synthetic row once.
    """
    real = real.withColumn("kind", F.lit("real")).withColumn("copy", F.lit(0))
    if ratio <= 0:
        return real
    n_syn = synthetic.count()
    once_each = synthetic.withColumn("kind", F.lit("synthetic"))
    if ratio >= 1 or n_syn == 0:
        return real.unionByName(once_each.withColumn("copy", F.lit(0)))
    n = max(1, round(real.count() * ratio / (1 - ratio)))
    rounds, extra = divmod(n, n_syn)
    full = once_each.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))) if rounds else None
    parts = [real] + ([full] if full is not None else [])
    if extra:
        parts.append(once_each.orderBy(order).limit(extra).withColumn("copy", F.lit(rounds)))
    return reduce(DataFrame.unionByName, parts)


def balanced_round_robin(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """``n`` rows taken from the keys in turn, each key starting over when used up; with ``turn`` from 0."""
    dim = df.groupBy(*keys).agg(F.count("*").alias("__size"))
    dim = dim.withColumn("__k", F.row_number().over(Window.orderBy(*keys)) - 1).withColumn("__keys", F.count("*").over(Window.partitionBy()))
    # no key is asked for more than its n first rows: the filter cuts a large key before the shuffle
    numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__rn") <= n)
    numbered = numbered.withColumn("__pos", F.col("__rn") - 1).drop("__rn")
    turns = df.sparkSession.range(n).withColumnRenamed("id", "turn")
    count = F.broadcast(dim.agg(F.max("__keys").alias("__keys")))
    picks = turns.crossJoin(count).withColumn("__k", F.pmod("turn", "__keys")).drop("__keys").join(F.broadcast(dim.drop("__keys")), "__k")
    picks = picks.withColumn("__pos", F.pmod(F.col("turn"), F.col("__size"))).drop("__k", "__size")
    return picks.join(numbered, [*keys, "__pos"]).drop("__pos")


def even_subsample(df: DataFrame, order: str, m: int) -> DataFrame:
    """``m`` rows at evenly spaced places of the order; all rows if there are no more."""
    n = df.count()
    if n <= m or m < 2:
        return df if n <= m else df.orderBy(order).limit(m)
    places = sorted({i * (n - 1) // (m - 1) for i in range(m)})
    listed = df.sparkSession.createDataFrame([(p,) for p in places], "__nth bigint")
    ranked = ordinal(df, order, "__nth")
    return ranked.join(F.broadcast(listed), "__nth", "left_semi").drop("__nth")


def ordinal(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 in order, without one task seeing all of them.

    Range partitions are counted, their offsets come from as many rows as
    there are partitions, and each partition numbers its own rows.
    """
    parts = cut(df.repartitionByRange(shuffle_width(df.sparkSession), order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__c"), F.min(order).alias("__lo"))
    before = F.sum("__c").over(Window.orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__offset"))
    return (
        parts.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + F.row_number().over(own.orderBy(order)) - 1)
        .drop("__part", "__offset")
    )


def experiment_matrix(*dimensions: DataFrame) -> DataFrame:
    """Every combination of small dimension tables."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dimensions)


def path_within(path: Column, root: Column) -> Column:
    """Whether a path is the root or lies below it."""
    p, r = F.rtrim(path, F.lit("/")), F.rtrim(root, F.lit("/"))
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def content_fingerprint(df: DataFrame, groups: list[str], identity: str, *columns: str) -> DataFrame:
    """(groups..., fingerprint): SHA-256 over the sorted digests of a group's rows, in two levels.

    Each row is reduced to its digest; digests with the same first three digits
    make one of at most 4,096 parts, whose own digests, in order of the parts,
    make the group's. No task gathers more than a part of a group.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (identity, *columns)]), 256)
    listed = lambda c: F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(c))), 256)
    parts = df.withColumn("__d", row).groupBy(*groups, F.substring("__d", 1, 3).alias("__p")).agg(listed("__d").alias("__h"), F.count("*").alias("__n"))
    return parts.groupBy(*groups).agg(listed(F.concat("__p", "__h")).alias("fingerprint"), F.sum("__n").alias("n_rows"))
