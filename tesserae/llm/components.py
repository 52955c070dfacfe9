"""Connected components of records that share entities, and splits by component.

Method: a star per entity (every record points at the entity's smallest
record), then large-star and small-star steps in turn until the edges rest.
Every step takes a minimum per node, of which map-side partials leave a row per
task, and joins it back; nodes with more than ``HOT`` rows, which are few by
that count, get theirs by broadcast and their rows are spread by hash, so an
entity with a third of all rows is no single task. Edges live in the shared
checkpoint folder between rounds, and only the last round's; two numbers per
round reach the driver.

Defined cases: records without id are left out; null entities link nothing;
repeated rows change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import cut, release

#: Rows of one node from which on it is hot; at most total / HOT nodes are.
HOT = 1_000_000
SALTS = 1024


def with_group_min(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``least``, the smallest ``value`` of the keys."""
    least = df.groupBy(*keys).agg(F.min(value).alias("least"), F.count("*").alias("n"))
    hot = least.filter(F.col("n") > HOT).select(*keys, F.col("least").alias("hot_least"))
    spread = F.when(F.col("hot_least").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(value), F.lit(SALTS))).cast("int")
    known = df.join(F.broadcast(hot), keys, "left").withColumn("salt", spread)
    cold = least.select(*keys, "least", F.lit(0).alias("salt"))
    return known.join(cold, [*keys, "salt"], "left").withColumn("least", F.coalesce("hot_least", "least")).drop("salt", "hot_least")


def entity_edges(members: DataFrame) -> DataFrame:
    """(u, v) with u > v from ``members`` (entity columns, id): a star per entity."""
    starred = with_group_min(members, [c for c in members.columns if c != "id"], "id")
    return starred.filter(F.col("id") > F.col("least")).select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = with_group_min(both, ["u"], "v").withColumn("least", F.least("u", "least"))
    return least.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    least = with_group_min(edges, ["u"], "v")
    moved = F.explode(F.array("u", "v")).alias("u")
    return least.select(moved, F.col("least").alias("v")).filter(F.col("u") > F.col("v"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(members: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every record linked to another; component = least id.

    ``members``: (entity, id). Rounds grow with the logarithm of the longest
    chain; not coming to rest within ``max_rounds`` is an error, not a result.
    """
    members = members.filter(F.col("entity").isNotNull() & F.col("id").isNotNull())
    # entities are named by 128 bits, far shorter than what they stand for, and worked out once
    members = cut(members.select("id", F.xxhash64("entity").alias("e1"), F.xxhash64(F.lit("e2"), "entity").alias("e2")))
    edges = cut(entity_edges(members))
    release(members)
    state = _state(edges)
    for _ in range(max_rounds):
        before, edges = edges, cut(small_star(large_star(edges)).distinct())
        release(before)
        last, state = state, _state(edges)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not come to rest in {max_rounds} rounds")
    centres = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres.withColumn("component", F.col("id")))


def split_of(component: Column, shares: dict[str, float], seed: str = "split-1") -> Column:
    """A split per component by hash, with the proportions of ``shares``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), component.cast("string")), 256), 1, 13)
    point = F.conv(digits, 16, 10).cast("double") / float(16**13)
    total, below, chosen = sum(shares.values()), 0.0, None
    for name, share in list(shares.items())[:-1]:
        below += share / total
        met = point < F.lit(below)
        chosen = F.when(met, name) if chosen is None else chosen.when(met, name)
    last = list(shares)[-1]
    return F.lit(last) if chosen is None else chosen.otherwise(last)


def split_together(records: DataFrame, id_column: str, entities: list[Column], shares: dict[str, float]) -> DataFrame:
    """(id, component, split): one row per record id, linked records together."""
    members = records.select(F.col(id_column).alias("id"), F.explode(F.array(*entities)).alias("entity"))
    linked = components(members)
    ids = records.select(F.col(id_column).alias("id")).filter("id is not null").distinct()
    whole = ids.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return whole.withColumn("split", split_of(F.col("component"), shares))


def split_report(splits: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per split: records, components, the share asked for and the actual one, and the largest component."""
    sizes = splits.groupBy("split", "component").agg(F.count("*").alias("n"))
    per = sizes.groupBy("split").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_components"), F.max("n").alias("largest_component"))
    asked = splits.sparkSession.createDataFrame([(k, v / sum(shares.values())) for k, v in shares.items()], "split string, asked_share double")
    whole = per.agg(F.sum("n_records").alias("whole"))
    rows = asked.join(per, "split", "left").join(whole)
    none = F.lit(0)
    return rows.select(
        "split", F.coalesce("n_records", none).alias("n_records"), F.coalesce("n_components", none).alias("n_components"), F.coalesce("largest_component", none).alias("largest_component"),
        "asked_share", F.coalesce(F.col("n_records") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
    )
