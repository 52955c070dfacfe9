"""References to files that do not exist, and what hangs on them.

Direct orphans are references to a file the inventory did not hold when the
record was made. A fixpoint cascade then walks the graph of who made which
file: what an orphaned record wrote is tainted, records that read a tainted
file are orphans by inheritance, and so on down until no new record is found.

Defined cases: a reference that names no file (null, blank, stand-in) is none;
records delivered twice count once; a record without time is orphaned only if
its file never existed; rows without record id are told apart by their time and
files; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.paths import file_key
from tesserae.operators.existence import alive_counts, live_events
from tesserae.session import cut


@dataclass(frozen=True)
class RecordTable:
    """How one table hangs in the graph of files."""

    name: str
    id_column: str
    #: Fields whose files must be in the inventory.
    references: tuple[str, ...] = ()
    #: Fields naming files the record itself wrote.
    produces: tuple[str, ...] = ()
    #: Further fields naming files that other records may have written.
    reads: tuple[str, ...] = field(default=())


TABLES = (
    RecordTable("auto_mask_records", "auto_mask_id", ("mask_path",), ("refined_mask_path",), ("image_path",)),
    RecordTable("generation_records", "generation_id", ("source_mask_path", "output_path"), ("output_path",),
                ("source_image_path", "background_path")),
    RecordTable("phase4_records", "phase4_id", ("phase2_feature_cache_path",), ("output_path",), ("background_path",)),
)

KEYS = ["table_name", "field_name", "record_id"]

#: What tells references apart: ``who`` is the record's id or, without one, a hash of its time and files.
ONCE = ["table_name", "field_name", "who"]


def links(df: DataFrame, table: RecordTable, fields: tuple[str, ...], *extra: Column) -> DataFrame:
    """One row per field that names a file: (table, field, id, who, key, at)."""
    named = dict.fromkeys((*table.references, *table.produces, *table.reads))
    unnamed = F.concat(F.lit("?"), F.xxhash64("created_at", *named).cast("string"))
    who = F.coalesce(df[table.id_column].cast("string"), unnamed).alias("who")
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), file_key(f).alias("key")) for f in fields])
    return (
        df.select(
            F.lit(table.name).alias("table_name"), df[table.id_column].alias("record_id"), who, df["created_at"].alias("at"), *extra, F.explode(pairs).alias("l")
        )
        .select("*", "l.field_name", "l.key")
        .drop("l")
        .filter(F.col("key").isNotNull())
    )


def direct_orphans(tables: dict[str, DataFrame], inventory: DataFrame, graph: tuple[RecordTable, ...] = TABLES) -> DataFrame:
    """(table_name, field_name, record_id, who, at, key, written) of every reference to a file not there at ``at``."""
    refs = [
        links(tables[t.name], t, t.references, F.array(*[tables[t.name][p] for p in t.produces]).cast("array<string>").alias("written"))
        for t in graph
        if t.references and t.name in tables
    ]
    asked = reduce(DataFrame.unionByName, refs)
    events = live_events(inventory, "rel_path", "registered_at", "deleted_at")
    found = alive_counts(asked, events, [*KEYS, "who", "written"])
    return found.filter(F.col("alive") <= 0).dropDuplicates(ONCE).drop("alive")


def cascade_orphans(
    tables: dict[str, DataFrame], inventory: DataFrame, graph: tuple[RecordTable, ...] = TABLES, max_rounds: int | None = None
) -> DataFrame:
    """All orphans: (table_name, field_name, record_id, at, key, kind, depth).

    ``kind`` is direct (depth 0) or inherited (depth of the shortest chain to
    a direct orphan). The loop ends when a round finds no new record; a graph
    with cycles ends too, as a record enters once. Not coming to rest within
    ``max_rounds``, if given, is an error, not a result.
    """
    found = cut(direct_orphans(tables, inventory, graph).withColumn("depth", F.lit(0)))
    readers = [
        links(tables[t.name], t, (*t.reads, *[r for r in t.references if r not in t.produces]),
              F.array(*[tables[t.name][p] for p in t.produces]).cast("array<string>").alias("written"))
        for t in graph if t.name in tables
    ]
    readers = reduce(DataFrame.unionByName, readers)
    rounds, frontier = [found], found
    while True:
        tainted = frontier.select(F.explode("written").alias("w")).select(file_key("w").alias("key")).filter("key is not null").distinct()
        seen = reduce(DataFrame.unionByName, [o.select("table_name", "who") for o in rounds])
        new = readers.join(tainted, "key", "left_semi").join(seen, ["table_name", "who"], "left_anti").dropDuplicates(ONCE)
        frontier = cut(new.withColumn("depth", F.lit(len(rounds))))
        if frontier.isEmpty():
            break
        if max_rounds is not None and len(rounds) >= max_rounds:
            raise RuntimeError(f"orphans did not come to rest in {max_rounds} rounds")
        if len(rounds) == 1:  # chains are rare: only one that goes on pays for keeping the parsed names
            readers = cut(readers)
        rounds.append(frontier)
    out = reduce(DataFrame.unionByName, [r.drop("written", "who") for r in rounds])
    return out.withColumn("kind", F.when(F.col("depth") == 0, "direct").otherwise("inherited"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month of the record and kind."""
    month = F.date_format(F.col("at"), "yyyy-MM")
    return orphans.groupBy("table_name", "field_name", month.alias("month"), "kind").agg(F.count("*").alias("n_refs"))
