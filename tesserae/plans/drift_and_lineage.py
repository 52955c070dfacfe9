"""Queries on dangling references, nested records and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.flatten import (
    AUTO_MASK_CHILDREN,
    candidate_table,
    component_table,
    linked_rows,
    prediction_table,
    reason_table,
    shred,
    sub_box_table,
    variant_table,
)
from tesserae.operators.orphans import TABLES, cascade_orphans, orphan_report
from tesserae.operators.rescue import ingest, promoted_names, schema_changes
from tesserae.session import cut, table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t.name: table(spark, sf_dir, t.name) for t in TABLES}
    return cascade_orphans(tables, table(spark, sf_dir, "artifact_inventory"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to files that did not exist when the record was made."""
    return _orphans(spark, sf_dir).filter(F.col("kind") == "direct").select("table_name", "field_name", "record_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans per table, field and month."""
    return orphan_report(_orphans(spark, sf_dir))


def _shredded(spark: SparkSession, sf_dir: str, values: bool = True) -> DataFrame:
    fields = ["settings", "mask_variant_paths", "mask_variant_overlay_paths"]
    return shred(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", fields, AUTO_MASK_CHILDREN, values)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flat child row with its parent's and its own key."""
    return linked_rows(_shredded(spark, sf_dir, values=False)).withColumnRenamed("id", "auto_mask_id")


def p3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat candidate table with its values."""
    return candidate_table(_shredded(spark, sf_dir)).withColumnRenamed("id", "auto_mask_id")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason with its text."""
    return reason_table(_shredded(spark, sf_dir)).withColumnRenamed("id", "auto_mask_id")


def p3_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction with its mode, expected overlap and disposition."""
    return prediction_table(_shredded(spark, sf_dir)).withColumnRenamed("id", "auto_mask_id")


def p3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of a prediction with its area and box."""
    return component_table(_shredded(spark, sf_dir)).withColumnRenamed("id", "auto_mask_id")


def p3_sub_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sub-box with its corners."""
    return sub_box_table(_shredded(spark, sf_dir)).withColumnRenamed("id", "auto_mask_id")


def p3_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mask variant with its paths."""
    return variant_table(_shredded(spark, sf_dir)).withColumnRenamed("id", "auto_mask_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed from each file to the next."""
    return schema_changes(table(spark, sf_dir, "raw_record_lines"))


#: Names approved by hand as further spellings of target fields; they go before what the renames of the data say.
APPROVED = {
    "auto_mask": {
        "evalMaskPath": "eval_mask_path", "eval_mask_file": "eval_mask_path", "evaluation_mask_path": "eval_mask_path", "mask_eval": "eval_mask_path",
        "uncertaintyMaskPath": "uncertainty_mask_path", "uncertainty_map_path": "uncertainty_mask_path", "unc_mask": "uncertainty_mask_path",
        "mask_uncertainty_uri": "uncertainty_mask_path", "conf": "confidence", "qwen_confidence": "confidence",
        "region": "region_xyxy", "bbox_xyxy": "region_xyxy", "settings.runId": "settings.auto_mask_run_id", "settings.run_id": "settings.auto_mask_run_id",
    },
    "generation": {
        "elapsed_sec": "latency_sec", "latency": "latency_sec", "settings.guidance": "settings.guidance_scale", "settings.cfg_scale": "settings.guidance_scale",
        "settings.guidanceScale": "settings.guidance_scale", "settings.steps": "settings.num_inference_steps", "settings.numSteps": "settings.num_inference_steps",
        "settings.neg_prompt": "settings.negative_prompt", "settings.promptNegative": "settings.negative_prompt", "settings.placement": "settings.placement_mode",
        "settings.placementMode": "settings.placement_mode", "settings.bbox": "settings.target_bbox_xyxy", "settings.target_region": "settings.target_bbox_xyxy",
        "settings.inpaint_mask": "settings.inpaint_mask_path", "settings.inpaintMaskPath": "settings.inpaint_mask_path",
    },
}


def _typed(spark: SparkSession, sf_dir: str, record_type: str) -> DataFrame:
    lines = table(spark, sf_dir, "raw_record_lines")
    found = promoted_names(lines, cut(schema_changes(lines)))[record_type]
    return ingest(lines, record_type, {**found, **APPROVED[record_type]})


def p6_auto_mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable auto-mask lines in one typed table."""
    return _typed(spark, sf_dir, "auto_mask")


def p6_generation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable generation lines in one typed table."""
    return _typed(spark, sf_dir, "generation")


QUERIES = {
    "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_candidates": p3_candidates,
    "p3_reasons": p3_reasons, "p3_predictions": p3_predictions, "p3_components": p3_components, "p3_sub_boxes": p3_sub_boxes, "p3_variants": p3_variants,
    "p6_found": p6_found, "p6_auto_mask_table": p6_auto_mask_table, "p6_generation_table": p6_generation_table,
}

_NAMED = r"""
named AS (
  SELECT table_name, field_name, record_id, created_at, trim(raw, chr(32)||chr(9)||chr(10)||chr(13)) AS raw FROM (
    SELECT 'auto_mask_records' AS table_name, 'mask_path' AS field_name, auto_mask_id AS record_id, created_at, mask_path AS raw FROM auto_mask_records
    UNION ALL SELECT 'generation_records', 'source_mask_path', generation_id, created_at, source_mask_path FROM generation_records
    UNION ALL SELECT 'generation_records', 'output_path', generation_id, created_at, output_path FROM generation_records
    UNION ALL SELECT 'phase4_records', 'phase2_feature_cache_path', phase4_id, created_at, phase2_feature_cache_path FROM phase4_records)
),
slashed AS (
  SELECT DISTINCT table_name, field_name, record_id, created_at,
    regexp_replace(regexp_replace(url_decode(raw), '^file://', ''), '\\', '/', 'g') AS p
  FROM named WHERE raw IS NOT NULL AND lower(raw) NOT IN ('', '-', '--', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', 'undefined', 'missing', 'tbd', '?')
),
resolved AS (
  SELECT table_name, field_name, record_id, created_at,
    regexp_replace(regexp_extract(
      regexp_replace(regexp_replace(regexp_replace(p, '/+(\./+)*', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '/[^/]+/\.\./', '/', 'g'),
      '((^|/)(data|outputs)(_[A-Za-z0-9]+)?/.*)$', 1), '^/', '') AS path
  FROM slashed
),
direct AS (
  SELECT table_name, field_name, record_id, created_at FROM resolved r
  WHERE NOT EXISTS (SELECT 1 FROM artifact_inventory a WHERE a.rel_path = r.path
    AND a.registered_at <= r.created_at AND (a.deleted_at IS NULL OR a.deleted_at > r.created_at))
)
"""

SQL = {
    "p2_found": f"WITH {_NAMED} SELECT table_name, field_name, record_id FROM direct",
    "p2_report": f"WITH {_NAMED} SELECT table_name, field_name, strftime(created_at, '%Y-%m') AS month, 'direct' AS kind, count(*) AS n_refs FROM direct GROUP BY ALL",
    "p3_found": """
WITH r AS (
  SELECT auto_mask_id, arg_min(settings, ingested_at) AS s, arg_min(mask_variant_paths, ingested_at) AS v, arg_min(mask_variant_overlay_paths, ingested_at) AS o
  FROM auto_mask_records GROUP BY auto_mask_id),
mode AS (
  SELECT DISTINCT auto_mask_id, unnest(list_concat(list_concat(coalesce(map_keys(s.candidate_scores), []), coalesce(map_keys(s.candidate_qc), [])),
    list_concat(coalesce(map_keys(s.candidate_refined_paths), []), coalesce(map_keys(s.candidate_heatmap_paths), [])))) AS m FROM r),
qc AS (SELECT auto_mask_id, unnest(map_entries(s.candidate_qc)) AS e FROM r),
reason AS (SELECT auto_mask_id, e.key AS k, unnest(e.value.reasons) AS x, generate_subscripts(e.value.reasons, 1) - 1 AS i FROM qc),
pred AS (SELECT auto_mask_id, unnest(s.candidate_predictions) AS x, generate_subscripts(s.candidate_predictions, 1) - 1 AS i FROM r),
comp AS (SELECT auto_mask_id, i, unnest(x.components) AS c, generate_subscripts(x.components, 1) - 1 AS j FROM pred),
box AS (SELECT auto_mask_id, unnest(s.qwen_sub_boxes_xyxy) AS x, generate_subscripts(s.qwen_sub_boxes_xyxy, 1) - 1 AS i FROM r),
variant AS (SELECT DISTINCT auto_mask_id, unnest(list_concat(coalesce(map_keys(v), []), coalesce(map_keys(o), []))) AS k FROM r)
SELECT auto_mask_id, 'candidate' AS child_table, '' AS parent_key, m AS child_key FROM mode
UNION ALL SELECT auto_mask_id, 'reason', k, i::VARCHAR FROM reason WHERE x IS NOT NULL
UNION ALL SELECT auto_mask_id, 'prediction', '', i::VARCHAR FROM pred WHERE x IS NOT NULL
UNION ALL SELECT auto_mask_id, 'component', i::VARCHAR, j::VARCHAR FROM comp WHERE c IS NOT NULL
UNION ALL SELECT auto_mask_id, 'sub_box', '', i::VARCHAR FROM box WHERE x IS NOT NULL
UNION ALL SELECT auto_mask_id, 'variant', '', k FROM variant
""",
    "p3_candidates": """
WITH r AS (SELECT auto_mask_id, arg_min(settings, ingested_at) AS s FROM auto_mask_records GROUP BY auto_mask_id),
mode AS (
  SELECT DISTINCT auto_mask_id, s, unnest(list_concat(list_concat(coalesce(map_keys(s.candidate_scores), []), coalesce(map_keys(s.candidate_qc), [])),
    list_concat(coalesce(map_keys(s.candidate_refined_paths), []), coalesce(map_keys(s.candidate_heatmap_paths), [])))) AS m FROM r)
SELECT auto_mask_id, m AS mode, s.candidate_scores[m] AS score, s.candidate_qc[m].mask_area AS mask_area,
  s.candidate_qc[m].mask_to_qwen_box_fraction AS box_fraction, s.candidate_qc[m].component_count AS component_count,
  s.candidate_refined_paths[m] AS refined_path, s.candidate_heatmap_paths[m] AS heatmap_path FROM mode
""",
    "p3_reasons": """
WITH r AS (SELECT auto_mask_id, arg_min(settings, ingested_at) AS s FROM auto_mask_records GROUP BY auto_mask_id),
qc AS (SELECT auto_mask_id, unnest(map_entries(s.candidate_qc)) AS e FROM r),
reason AS (SELECT auto_mask_id, e.key AS mode, unnest(e.value.reasons) AS reason, (generate_subscripts(e.value.reasons, 1) - 1)::INT AS reason_no FROM qc)
SELECT auto_mask_id, mode, reason_no, reason FROM reason WHERE reason IS NOT NULL
""",
    "p3_predictions": """
WITH r AS (SELECT auto_mask_id, arg_min(settings, ingested_at) AS s FROM auto_mask_records GROUP BY auto_mask_id),
pred AS (SELECT auto_mask_id, unnest(s.candidate_predictions) AS x, (generate_subscripts(s.candidate_predictions, 1) - 1)::INT AS i FROM r)
SELECT auto_mask_id, i AS prediction_no, x.mode AS mode, x.expected_iou AS expected_iou, x.disposition AS disposition FROM pred WHERE x IS NOT NULL
""",
    "p3_components": """
WITH r AS (SELECT auto_mask_id, arg_min(settings, ingested_at) AS s FROM auto_mask_records GROUP BY auto_mask_id),
pred AS (SELECT auto_mask_id, unnest(s.candidate_predictions) AS x, (generate_subscripts(s.candidate_predictions, 1) - 1)::INT AS i FROM r),
comp AS (SELECT auto_mask_id, i, unnest(x.components) AS c, (generate_subscripts(x.components, 1) - 1)::INT AS j FROM pred)
SELECT auto_mask_id, i AS prediction_no, j AS component_no, c.area AS area, c.box_xyxy AS box_xyxy FROM comp WHERE c IS NOT NULL
""",
    "p3_sub_boxes": """
WITH r AS (SELECT auto_mask_id, arg_min(settings, ingested_at) AS s FROM auto_mask_records GROUP BY auto_mask_id),
box AS (SELECT auto_mask_id, unnest(s.qwen_sub_boxes_xyxy) AS x, (generate_subscripts(s.qwen_sub_boxes_xyxy, 1) - 1)::INT AS i FROM r)
SELECT auto_mask_id, i AS box_no, x AS box_xyxy FROM box WHERE x IS NOT NULL
""",
    "p3_variants": """
WITH r AS (SELECT auto_mask_id, arg_min(mask_variant_paths, ingested_at) AS v, arg_min(mask_variant_overlay_paths, ingested_at) AS o FROM auto_mask_records GROUP BY auto_mask_id),
variant AS (SELECT DISTINCT auto_mask_id, v, o, unnest(list_concat(coalesce(map_keys(v), []), coalesce(map_keys(o), []))) AS k FROM r)
SELECT auto_mask_id, k AS variant, v[k] AS mask_path, o[k] AS overlay_path FROM variant
""",
}
