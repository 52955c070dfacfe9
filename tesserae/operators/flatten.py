"""Deeply nested records as flat tables that keep parent and child keys.

Records are written as JSON and shredded by the structural index of
``json_index`` in Arrow batches. A ``ChildTable`` names paths into the record;
each value found there becomes a row with its parent's and its own key.

Defined cases: a null or empty container has no rows; null elements of arrays
have none but keep their place in the counting; a null value of a map keeps
its key; a record delivered twice is one record (the earliest delivery is
kept); records without id are left out; columns the paths
do not name are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.json_index import JsonIndex

#: Bytes of JSON indexed at once in a worker.
BATCH_BYTES = 4_000_000


@dataclass(frozen=True)
class ChildTable:
    """Rows of one flat table: values at any of ``paths`` (``*`` key, ``#`` element)."""

    name: str
    paths: tuple[tuple[str, ...], ...]
    #: Levels from the row up to the ancestor whose key is the parent key; 0 for none.
    parent_levels: int = 0
    #: Whether null values make rows.
    keep_null: bool = False


AUTO_MASK_CHILDREN = (
    ChildTable("candidate", tuple(("settings", f, "*") for f in ("candidate_scores", "candidate_qc", "candidate_refined_paths", "candidate_heatmap_paths")), keep_null=True),
    ChildTable("reason", (("settings", "candidate_qc", "*", "reasons", "#"),), parent_levels=2),
    ChildTable("prediction", (("settings", "candidate_predictions", "#"),)),
    ChildTable("component", (("settings", "candidate_predictions", "#", "components", "#"),), parent_levels=2),
    ChildTable("sub_box", (("settings", "qwen_sub_boxes_xyxy", "#"),)),
    ChildTable("variant", (("mask_variant_paths", "*"), ("mask_variant_overlay_paths", "*")), keep_null=True),
)


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES:
            yield ids[first : i + 1], texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield ids[first:], texts[first:]


def shred(records: DataFrame, id_column: str, fields: list[str], children: tuple[ChildTable, ...], values: bool = True) -> DataFrame:
    """(id, child_table, field, parent_key, child_key, value) of every child row.

    ``field`` is the member of the path the value stands under, ``value`` its
    JSON text, or null if values are not asked for.
    """
    first = F.struct(records["ingested_at"].isNull().alias("late"), records["ingested_at"])
    once = records.filter(records[id_column].isNotNull()).groupBy(records[id_column].alias("id")).agg(F.min_by(F.struct(*[records[f] for f in fields]), first).alias("r"))
    source = once.select("id", F.to_json("r", {"ignoreNullFields": "false"}).alias("json")).filter(F.col("json").isNotNull())
    id_type = source.schema["id"].dataType
    schema = f"id {id_type.simpleString()}, child_table string, field string, parent_key string, child_key string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _shred_texts(ids, texts, children, batch.schema.field(0).type, values)

    return source.mapInArrow(run, schema)


def _shred_texts(ids: list, texts: list[str], children: tuple[ChildTable, ...], id_type: pa.DataType, values: bool = True) -> Iterator[pa.RecordBatch]:
    index = JsonIndex(texts)
    known = pa.array(ids, id_type)
    for child in children:
        for path in child.paths:
            rows = index.select(path)
            if not child.keep_null:
                rows = rows[~index.is_null(rows)]
            if not len(rows):
                continue
            up = rows
            for _ in range(child.parent_levels):
                up = index.parent[up]
            parents = index.labels(up) if child.parent_levels else [""] * len(rows)
            field = next(p for p in reversed(path[:-1]) if p not in "*#")
            yield pa.RecordBatch.from_arrays(
                [
                    known.take(pa.array(index.doc[rows])),
                    pa.repeat(child.name, len(rows)),
                    pa.repeat(field, len(rows)),
                    pa.array(parents),
                    pa.array(index.labels(rows)),
                    pa.array(index.texts(rows)) if values else pa.nulls(len(rows), pa.string()),
                ],
                ["id", "child_table", "field", "parent_key", "child_key", "value"],
            )


def linked_rows(shredded: DataFrame) -> DataFrame:
    """One row per child row, whichever of its fields it was found in."""
    return shredded.select("id", "child_table", "parent_key", "child_key").distinct()


def candidate_table(shredded: DataFrame) -> DataFrame:
    """The candidate rows with their values side by side."""
    rows = shredded.filter(F.col("child_table") == "candidate").withColumn("value", F.when(F.col("value") != "null", F.col("value")))
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    text = lambda f: F.get_json_object(F.concat(F.lit('{"v":'), pick(f), F.lit("}")), "$.v")
    qc = pick("candidate_qc")
    return rows.groupBy("id", F.col("child_key").alias("mode")).agg(
        pick("candidate_scores").try_cast("double").alias("score"),
        F.get_json_object(qc, "$.mask_area").try_cast("int").alias("mask_area"),
        F.get_json_object(qc, "$.mask_to_qwen_box_fraction").try_cast("double").alias("box_fraction"),
        F.get_json_object(qc, "$.component_count").try_cast("int").alias("component_count"),
        text("candidate_refined_paths").alias("refined_path"),
        text("candidate_heatmap_paths").alias("heatmap_path"),
    )


def _of(shredded: DataFrame, child: str) -> DataFrame:
    return shredded.filter(F.col("child_table") == child)


def _text(value: Column) -> Column:
    """A JSON value as text, strings without their quotes."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def reason_table(shredded: DataFrame) -> DataFrame:
    """(id, mode, reason_no, reason) of every reason."""
    return _of(shredded, "reason").select("id", F.col("parent_key").alias("mode"), F.col("child_key").cast("int").alias("reason_no"), _text(F.col("value")).alias("reason"))


def prediction_table(shredded: DataFrame) -> DataFrame:
    """(id, prediction_no, mode, expected_iou, disposition) of every prediction."""
    member = lambda m: F.get_json_object("value", f"$.{m}")
    return _of(shredded, "prediction").select(
        "id", F.col("child_key").cast("int").alias("prediction_no"), member("mode").alias("mode"), member("expected_iou").try_cast("double").alias("expected_iou"), member("disposition").alias("disposition")
    )


def component_table(shredded: DataFrame) -> DataFrame:
    """(id, prediction_no, component_no, area, box_xyxy) of every component of a prediction."""
    return _of(shredded, "component").select(
        "id", F.col("parent_key").cast("int").alias("prediction_no"), F.col("child_key").cast("int").alias("component_no"),
        F.get_json_object("value", "$.area").try_cast("int").alias("area"), F.from_json(F.get_json_object("value", "$.box_xyxy"), "array<int>").alias("box_xyxy"),
    )


def sub_box_table(shredded: DataFrame) -> DataFrame:
    """(id, box_no, box_xyxy) of every sub-box."""
    return _of(shredded, "sub_box").select("id", F.col("child_key").cast("int").alias("box_no"), F.from_json("value", "array<int>").alias("box_xyxy"))


def variant_table(shredded: DataFrame) -> DataFrame:
    """(id, variant, mask_path, overlay_path): the paths of each variant side by side."""
    rows = _of(shredded, "variant").withColumn("path", F.when(F.col("value") != "null", _text(F.col("value"))))
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("path")))
    return rows.groupBy("id", F.col("child_key").alias("variant")).agg(pick("mask_variant_paths").alias("mask_path"), pick("mask_variant_overlay_paths").alias("overlay_path"))
