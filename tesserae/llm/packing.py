"""Filling fixed-capacity containers with items of varying size.

Method: hierarchical residual packing. Items are spread over partitions of a
bounded number of items; each packs best-fit, largest first, and emits the
containers that are nearly full. Underfull containers become items themselves
and meet others in fewer partitions, round after round, until one partition
has packed all that is left or no two of them fit into one container, which a
round that merges nothing shows or the two smallest do. Containers only ever
merge whole, so a text is never cut unless it is larger than a container; then
it becomes full pieces and one rest.

Defined cases: an empty or null text has size 0 and goes to a container of its
partition all the same; of equal sizes the earlier row goes first; rows without
id are left out; repeated ids are packed as often as they come; an empty table
gives an empty result. Full pieces have negative container numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import cut

CAPACITY = 2048
#: Items one task packs at a time.
PARTITION_ITEMS = 8192
#: A container's number has seven bits for its round.
MAX_ROUNDS = 127
#: Free room up to which a container is closed, as a share of the capacity.
NEARLY_FULL = 1 / 128


def split_large(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece_no, token_start, n_tokens): items no larger than a container.

    ``sizes``: (id, n_tokens).
    """
    count = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    whole = sizes.filter("id is not null").select("id", "n_tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_no"))
    start = (F.col("piece_no") * F.lit(capacity)).cast("bigint")
    return whole.select("id", "piece_no", start.alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("n_tokens"))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item: largest first, each into the fullest container it fits.

    Open containers lie in stacks by free room; one integer has a bit for every
    room that has any, so the best fit is its lowest bit at or above the size.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for i in order:
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            c = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, c = capacity, used
            used += 1
        left = room - s
        stacks[left].append(c)
        rooms |= 1 << left
        out[i] = c
    return out


def _round(items: DataFrame, capacity: int, partitions: int, number: int) -> DataFrame:
    """``items`` with the container of this round (``bin``) and its ``fill``."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", ignore_index=True)
        local = best_fit(group["size"].to_numpy(), capacity)
        fill = np.bincount(local, group["size"], minlength=1).astype(np.int64)
        part = int(group["part"].iloc[0])
        return group.drop(columns="part").assign(bin=(number << 56) | (part << 28) | local, fill=fill[local].astype(np.int32))

    part = F.pmod(F.xxhash64("item", F.lit(number)), F.lit(partitions)).cast("int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", bin bigint, fill int"
    return items.withColumn("part", part).groupBy("part").applyInPandas(pack, schema)


def pack_items(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (id, piece_no, token_start, n_tokens) with ``container_id``."""
    if capacity >= 1 << 28:
        raise ValueError("capacity must be below 2**28")
    columns = ["id", "piece_no", "token_start", "n_tokens"]
    # numbered on the materialised pieces: unique even for repeated ids, and the same whenever a task is run again
    pieces = cut(pieces).select(*columns, F.monotonically_increasing_id().alias("item"))
    limit = capacity - max(1, int(capacity * NEARLY_FULL))
    items = pieces.filter(F.col("n_tokens") < capacity).withColumn("size", F.col("n_tokens"))
    rounds, count = [], items.count()
    while True:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"containers still merge after {MAX_ROUNDS} rounds")
        partitions = max(1, math.ceil(count / PARTITION_ITEMS))
        done = cut(_round(items, capacity, partitions, len(rounds) + 1))
        rounds.append(done)
        items = cut(done.filter(F.col("fill") < limit).groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("size"), F.count("*").alias("held")))
        left = items.agg(F.count("*").alias("bins"), F.coalesce(F.sum("held"), F.lit(0)).alias("held")).first()
        least = [r["size"] for r in items.select("size").orderBy("size").limit(2).collect()]
        merged = left["held"] < count or left["bins"] < left["held"]
        if partitions == 1 or len(least) < 2 or sum(least) > capacity or not merged:
            break
        items, count = items.drop("held"), left["bins"]
    placed = rounds[0].select(*columns, F.col("bin").alias("at"))
    # rounds after the first only hold underfull containers: their links are joined with one another, and once with the items
    onward = None
    for done in reversed(rounds[1:]):
        step = done.select(F.col("item").alias("at"), "bin")
        if onward is not None:
            step = step.join(onward.select(F.col("at").alias("bin"), "final"), "bin", "left").select("at", F.coalesce("final", "bin").alias("final"))
        else:
            step = step.withColumnRenamed("bin", "final")
        onward = step
    if onward is not None:
        placed = placed.join(onward, "at", "left").select(*columns, F.coalesce("final", "at").alias("at"))
    own = pieces.filter(F.col("n_tokens") >= capacity).select(*columns, (-1 - F.col("item")).alias("at"))
    return placed.unionByName(own).withColumnRenamed("at", "container_id")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, pieces, tokens and the share of room that is used; one row."""
    fills = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("pieces"))
    return fills.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"),
        F.max("fill").alias("fullest"), (F.sum("fill") / (F.count("*") * capacity)).alias("used"),
        F.greatest(F.lit(0), F.ceil(F.sum("fill") / capacity)).alias("least_containers"),
    )
