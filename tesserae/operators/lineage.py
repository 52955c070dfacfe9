"""Checks of where records come from: splits, versions, references, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """``df``; a row that meets ``bad`` fails the query."""
    fine = F.assert_true(~F.coalesce(bad, F.lit(False)), F.lit(message))
    return df.withColumn("__ok", fine).filter("__ok is null").drop("__ok")


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on both sides; none if the sides are disjoint."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def unassigned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` does not have."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def counts_for(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, n_rows) for exactly the listed values, 0 where there are none."""
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"`{key}` string")
    counted = df.groupBy(key).agg(F.count("*").alias("n_rows"))
    return F.broadcast(listed).join(counted, key, "left").fillna(0, ["n_rows"])


def manifest(df: DataFrame, target: list[str], split: str, sample: list[str], order: str) -> DataFrame:
    """(target, adaptation, held_out): a nested manifest row per target, samples in order.

    For manifests, which list the samples of one target; not for whole tables.
    """
    name = F.concat_ws("/", *target)
    picked = lambda s: F.sort_array(F.collect_list(F.when(F.col(split) == s, F.struct(order, *sample))))
    return df.groupBy(name.alias("target")).agg(picked("adaptation").alias("adaptation"), picked("held_out").alias("held_out"))


def manifest_samples(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """(target, split, place, sample...): a manifest flattened, each split in stored order, held-out samples cut at ``cap``."""
    sides = []
    for s in ("adaptation", "held_out"):
        listed = F.slice(s, 1, cap) if cap and s == "held_out" else F.col(s)
        sides.append(rows.select("target", F.lit(s).alias("split"), F.posexplode(listed).alias("place", "sample")))
    return sides[0].unionByName(sides[1]).select("target", "split", "place", "sample.*")


def fuse_scores(df: DataFrame, first: str, second: str, weight: float, out: str) -> DataFrame:
    """``df`` with ``out``: two arrays blended place by place and kept within 0 and 1; unequal lengths fail the query."""
    w = min(1.0, max(0.0, weight))
    unequal = ~F.size(first).eqNullSafe(F.size(second)) | F.col(first).isNull() | F.col(second).isNull()
    blend = F.zip_with(first, second, lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * (1 - w) + b * w)))
    return guard(df, unequal, "Cannot fuse scores with different shapes").withColumn(out, blend)


def fuse_score_rows(student: DataFrame, prior: DataFrame, key: list[str], score: str, weight: float) -> DataFrame:
    """The student's rows with ``score`` fused with that of the prior's row at the same key.

    ``student_score`` and ``prior_score`` keep the parts. A key that stands on
    one side only fails the query; keys are unique.
    """
    a = student.withColumnRenamed(score, "student_score").withColumn("__a", F.lit(True))
    b = prior.select(*key, F.col(score).alias("prior_score"), F.lit(True).alias("__b"))
    both = guard(a.join(b, key, "full_outer"), F.col("__a").isNull() | F.col("__b").isNull(), "Cannot fuse score rows with different lengths")
    return fuse_scores(both.drop("__a", "__b"), "student_score", "prior_score", weight, score)


def exists_audit(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """(table_name, field_name, n_refs, n_known, n_unknown): references whose file the inventory ever had."""
    known = inventory.select(F.col("rel_path").alias("key")).filter("key is not null").distinct().withColumn("known", F.lit(1))
    counted = refs.join(known, "key", "left").groupBy("table_name", "field_name")
    return counted.agg(F.count("*").alias("n_refs"), F.count("known").alias("n_known"), F.count_if(F.col("known").isNull()).alias("n_unknown"))


def mask_role(path: Column) -> Column:
    """What a mask is for, by its path; the first word that fits counts."""
    p = F.lower(F.coalesce(path, F.lit("")))
    rules = (("/eval", "evaluation"), ("unc", "uncertainty"), ("train", "training"), ("soft", "training"), ("ground_truth", "truth"), ("refined", "refined"))
    out = None
    for word, role in rules:
        met = F.contains(p, F.lit(word))
        out = F.when(met, role) if out is None else out.when(met, role)
    return out.when(p == "", "none").otherwise("other")


def path_references(df: DataFrame, column: str) -> DataFrame:
    """(key, value): texts inside a nested column that look like paths, with their dotted key.

    The column is walked by its schema, so only text leaves are read.
    """
    leaves = _text_leaves(df.schema[column].dataType, column)
    pairs = F.array(*[F.struct(F.lit(name).alias("key"), F.expr(f"`{name.replace('.', '`.`')}`").alias("value")) for name in leaves])
    return df.select(F.explode(pairs).alias("p")).select("p.key", "p.value").filter(F.col("value").rlike(r"[/\\]"))


def _text_leaves(kind, name: str) -> list[str]:
    if kind.typeName() == "struct":
        return [x for f in kind.fields for x in _text_leaves(f.dataType, f"{name}.{f.name}")]
    return [name] if kind.typeName() == "string" else []
