"""Mixing sources to target weights, in tokens.

Method: Sainte-Laguë apportionment. The total is cut into blocks of equal
tokens, ``RESOLUTION`` per source and never less than a token. Sources get
whole blocks by the highest quotients of their shares; within a source, groups
of shards and then the shards of each group get blocks of their source's
tokens the same way by the tokens they hold. In each shard documents stand in
a seeded order; its quota takes all of them as often as it has full rounds,
and for the rest those that fit, one after another from a seeded block on,
and last the one that comes closest to what is left.

The total is the largest for which no source must exceed ``max_repeat``,
unless a smaller one is asked for. Targets without any token can not be met;
their shares fall to the others in proportion, and the report says so.

Defined cases: sources without a target are not used; a null source is none;
null and empty texts have no tokens and are never chosen; a target that is
null or not positive, or a repeat below one, gives the source nothing; rows
without id are left out; of repeated ids one is used; empty tables give an
empty result; more than ``MAX_TARGETS`` sources that hold tokens are an error.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import broadcast_if_small, cut

#: Blocks a total is cut into, per part it goes to.
RESOLUTION = 1000
#: Documents of a source per shard, about, and shards per group of shards.
SHARD_DOCS = 20_000
GROUP_SHARDS = 1000
#: Sources with a target; the table of targets is the user's and small.
MAX_TARGETS = 100_000


def sainte_lague(shares: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Whole seats by the highest quotients share / (2 s + 1), first wins on ties; no more than ``caps``."""
    total = sum(x for x in shares if x > 0)
    if total <= 0 or seats <= 0:
        return [0] * len(shares)
    limit = [math.inf] * len(shares) if caps is None else caps
    # seats that every rounding of the exact quotas gives, the rest one by one
    won = [int(min(limit[i], max(0, math.floor(x / total * seats) - 1))) if x > 0 else 0 for i, x in enumerate(shares)]
    queue = [(-x / (2 * won[i] + 1), i) for i, x in enumerate(shares) if x > 0 and won[i] < limit[i]]
    heapq.heapify(queue)
    left = seats - sum(won)
    while left > 0 and queue:
        _, i = heapq.heappop(queue)
        won[i] += 1
        left -= 1
        if won[i] < limit[i]:
            heapq.heappush(queue, (-shares[i] / (2 * won[i] + 1), i))
    return won


def apportion(quota: int, weights: list[float], caps: list[int]) -> list[int]:
    """``quota`` tokens to parts in equal blocks by Sainte-Laguë, none above its cap."""
    if quota <= 0 or not weights:
        return [0] * len(weights)
    block = max(1, quota // (RESOLUTION * len(weights)))
    return [n * block for n in sainte_lague(weights, quota // block, [c // block for c in caps])]


def choose(sizes: np.ndarray, quota: int, first: int) -> np.ndarray:
    """How often each document is used so that the tokens come to about ``quota``."""
    whole = int(sizes.sum())
    rounds, left = divmod(quota, whole)
    again = np.zeros(len(sizes), np.int64)
    if left:
        start = int(np.searchsorted(np.cumsum(sizes), first, side="right")) if first else 0
        for i in np.r_[start : len(sizes), 0:start]:
            if sizes[i] <= left:
                again[i] = 1
                left -= int(sizes[i])
        free = np.flatnonzero(again == 0)
        if left and len(free):
            near = free[np.argmin(np.abs(sizes[free] - left))]
            if abs(int(sizes[near]) - left) < left:
                again[near] = 1
    return rounds + again


def _apportioned(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``parts`` (keys, part, tokens, quota, max_repeat) with the quota of all their rows shared out per group of keys."""

    def share(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(part, ignore_index=True)
        tokens = [int(t) for t in group["tokens"]]
        won = apportion(int(group["quota"].iloc[0]), [float(t) for t in tokens], [t * int(r) for t, r in zip(tokens, group["max_repeat"])])
        return group[[*keys, part]].assign(quota=won)

    types = dict(parts.dtypes)
    return parts.groupBy(*keys).applyInPandas(share, ", ".join(f"{c} {types[c]}" for c in [*keys, part]) + ", quota bigint")


def mix_sources(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: str = "mix-1") -> DataFrame:
    """(id, source, n_tokens, repeats) of the chosen documents.

    ``sizes``: (id, source, n_tokens); ``targets``: (source, target_share, max_repeat).
    """
    sizes = sizes.select("id", "source", "n_tokens").filter("id is not null and source is not null and n_tokens > 0").dropDuplicates(["id"])
    wanted = targets.select("source", "target_share", "max_repeat").filter("source is not null and target_share > 0 and max_repeat >= 1").dropDuplicates(["source"])
    held = cut(sizes.join(wanted.select("source"), "source", "left_semi"))
    # one row per target comes to the driver, and not more than the bound
    stock = held.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).join(wanted, "source")
    plan = sorted(stock.limit(MAX_TARGETS + 1).collect(), key=lambda r: r["source"])
    if len(plan) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sources with a target")
    if not plan:
        return held.select("id", "source", "n_tokens", F.lit(0).alias("repeats")).limit(0)
    shares, most = [float(r["target_share"]) for r in plan], [int(r["max_repeat"]) * int(r["tokens"]) for r in plan]
    total = min(int(m * (sum(shares) / s)) for m, s in zip(most, shares))
    total = total if total_tokens is None else min(total, total_tokens)
    won = apportion(total, shares, most)
    quota = held.sparkSession.createDataFrame(
        [(r["source"], max(1, math.ceil(r["docs"] / SHARD_DOCS)), w, int(r["max_repeat"])) for r, w in zip(plan, won)], "source string, shards int, quota bigint, max_repeat int"
    )
    quota = broadcast_if_small(quota, len(plan))
    spot = lambda *c: F.xxhash64(F.lit(seed), *c)
    docs = held.join(quota.select("source", "shards"), "source").withColumn("shard", F.pmod(spot("id"), F.col("shards")).cast("int"))
    docs = docs.select("id", "source", "n_tokens", "shard")

    shards = cut(docs.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).withColumn("grp", F.floor(F.col("shard") / GROUP_SHARDS).cast("int")))
    groups = shards.groupBy("source", "grp").agg(F.sum("tokens").alias("tokens")).join(quota.drop("shards"), "source")
    groups = _apportioned(groups, ["source"], "grp")
    shards = shards.join(groups, ["source", "grp"]).join(quota.select("source", "max_repeat"), "source")
    shards = cut(_apportioned(shards, ["source", "grp"], "shard").select("source", "shard", "quota"))
    count = sum(max(1, math.ceil(r["docs"] / SHARD_DOCS)) for r in plan)
    placed = docs.join(broadcast_if_small(shards, count), ["source", "shard"])
    placed = placed.select("*", spot("id", F.lit("order")).alias("spot"), spot("source", "shard").alias("first"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["spot", "id"], ignore_index=True)
        tokens = group["n_tokens"].to_numpy(np.int64)
        group["repeats"] = choose(tokens, int(group["quota"].iloc[0]), int(group["first"].iloc[0]) % int(tokens.sum()))
        return group.loc[group["repeats"] > 0, ["id", "source", "n_tokens", "repeats"]]

    types = dict(held.dtypes)
    return placed.groupBy("source", "shard").applyInPandas(pick, f"id {types['id']}, source string, n_tokens {types['n_tokens']}, repeats int")


def mix_report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of either list: target, tokens held and chosen, actual share, largest repeat."""
    held = sizes.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens_held"))
    chosen = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_chosen"), F.max("repeats").alias("most_repeats"), F.count("*").alias("n_docs")
    )
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("total"))
    rows = targets.select("source", "target_share", "max_repeat").join(held, "source", "full_outer").join(chosen, "source", "left").join(F.broadcast(total))
    return rows.select(
        "source", "target_share", "max_repeat", F.coalesce("tokens_held", F.lit(0)).alias("tokens_held"), F.coalesce("tokens_chosen", F.lit(0)).alias("tokens_chosen"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("tokens_chosen") / F.col("total"), F.lit(0.0)).alias("actual_share"),
    )
