"""Queries on structures, selection policies, arbitration, localisation and answers.

The test tables name categories, types, modes and reasons in words of their
own; ``ALIASES`` binds them to those the policies know, as an allow-list with
aliases does. They hold no masks, so what the chain gate measures on a mask is
stood for by multiples of the candidate's share of the box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.scalars import finite
from tesserae.operators import policy as P
from tesserae.operators import relational as R
from tesserae.session import table

QUERIES: dict = {}
SQL: dict = {}

SIZE = 512
ALIASES = {
    "category": {"bottle_neck": "bottle", "zip_chain": "zipper"},
    "defect": {"chip": "broken_small", "crack": "broken_large", "fray": "fabric_border", "warp": "broken_teeth", "cut": "split_teeth"},
    "mode": {"nearest_normal": "nearest_normal_residual", "patch_memory": "patchcore_guided", "consensus": "ensemble_consensus", "fft_notch": "fft_texture_suppression",
             "polar_ring": "polar_rim_residual", "band_clean": "scratch_band_clean", "multi_fusion": "normal_residual_fusion", "heat_gate": "sam2_heatmap"},
    "reason": {"touches_border": "touches_image_border", "area_too_large": "large_image_area", "area_too_small": "tiny_fraction_of_qwen_box", "outside_box": "large_fraction_of_qwen_box"},
}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def normalised(value: Column, kind: str) -> Column:
    """The known name a written one stands for; others stay as they are."""
    known = F.create_map(*[F.lit(x) for kv in ALIASES[kind].items() for x in kv])
    return F.coalesce(F.try_element_at(known, value), value)


def _sql_alias(x: str, kind: str) -> str:
    return f"CASE {x} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES[kind].items())} ELSE {x} END"


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once, however often they are used: what an explode gives out is not folded into its uses."""
    for name, value in columns.items():
        rows = rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))
    return rows


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auto-mask records with known names, a valid region, their candidates, policy and gate."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "category", "defect_type", "description", "region_xyxy", "settings")
    scores, qc = F.col("settings.candidate_scores"), F.col("settings.candidate_qc")

    def candidate(e: Column) -> Column:
        q = F.try_element_at(qc, e["key"])
        area = F.coalesce(q["mask_area"], F.lit(0))
        why = F.coalesce(F.filter(q["reasons"], lambda r: r.isNotNull()), F.array().cast("array<string>"))
        return F.struct(
            normalised(e["key"], "mode").alias("mode"), finite(e["value"]).alias("score"), area.alias("mask_area"), q["mask_to_qwen_box_fraction"].alias("box_fraction"),
            F.lit(None).cast("double").alias("image_fraction"), q["component_count"].alias("components"), F.transform(why, lambda r: normalised(r, "reason")).alias("reasons"),
            F.when(area <= 0, "reject").when(F.size(why) > 0, "warning").otherwise("pass").alias("status"), F.create_map().cast("map<string,double>").alias("parameters"),
        )

    placed = P.validated_region(F.col("region_xyxy"), SIZE, SIZE)
    found = F.coalesce(F.transform(F.map_entries(scores), candidate), F.array().cast(f"array<{P.CANDIDATE}>"))
    rows = _once(rows, candidates=found, placed=placed).select(
        "auto_mask_id", normalised(F.col("category"), "category").alias("category"), normalised(F.col("defect_type"), "defect").alias("defect"), "description",
        "candidates", "placed", F.col("placed.region").alias("region"), F.array(F.lit(SIZE), F.lit(SIZE)).alias("size"),
    )
    rows = _once(rows, policy=P.selection_policy(F.col("category"), F.col("defect"), F.col("description"), F.col("region"), F.col("candidates")))
    box = F.coalesce(P.candidate_of(F.col("candidates"), "patchcore_guided")["box_fraction"], F.lit(0.0))
    longest = F.greatest(F.col("region")[2] - F.col("region")[0], F.col("region")[3] - F.col("region")[1]) / SIZE
    gate = P.chain_gate(F.col("placed.status"), longest, F.least(F.lit(1.0), box * 8), F.least(F.lit(1.0), box * 4))
    return _once(rows, gate=gate).withColumn("met", F.col("gate.enabled")).withColumn("why", F.col("gate.reason"))


def adjusted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``images`` with ``adjusted``, the moved score of every candidate."""
    rows = _once(images(spark, sf_dir), adjusted=P.adjusted_candidates("candidates", "policy", "region", "size", "met"))
    return _once(rows, adjusted=P.with_ensemble(F.col("adjusted"), F.col("policy")))


def _has(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_EDGE, _IN_EDGE, _RING, _DIRT = (_has("t", w) for w in (P.EDGE_WORDS, P.EDGE_CONTEXT, P.RING_WORDS, P.DIRT_WORDS))
_STRUCTURE = f"""CASE WHEN {_EDGE} AND {_IN_EDGE} THEN 'edge_border' WHEN {_has('t', P.CHAIN_WORDS)} THEN 'repeated_chain'
  WHEN {_RING} THEN CASE WHEN {_DIRT} THEN 'flat_surface_patch' ELSE 'ring_sector' END WHEN {_has('t', P.LINE_WORDS)} THEN 'thin_linear'
  WHEN {_has('t', P.SCUFF_WORDS)} THEN 'multi_scuff' WHEN {_has('t', P.PATCH_WORDS)} THEN 'flat_surface_patch' ELSE 'unknown' END"""

_IMAGES = f"""
one AS (SELECT * FROM auto_mask_records QUALIFY row_number() OVER (PARTITION BY auto_mask_id ORDER BY ingested_at) = 1),
named AS (SELECT auto_mask_id, coalesce({_sql_alias('category', 'category')}, '') AS category, coalesce({_sql_alias('defect_type', 'defect')}, '') AS defect, coalesce(description, '') AS description,
  settings AS s, region_xyxy AS r, len(region_xyxy) = 4 AND len(list_filter(region_xyxy, lambda x: x IS NULL)) = 0 AS four FROM one),
clipped AS (SELECT *, greatest(0, least(511, r[1])) AS x1, greatest(0, least(511, r[2])) AS y1, greatest(1, least(512, r[3])) AS x2, greatest(1, least(512, r[4])) AS y2 FROM named),
judged AS (SELECT *, CASE WHEN r IS NULL OR NOT four THEN 'no_box' WHEN x2 <= x1 OR y2 <= y1 THEN 'empty_after_clipping' WHEN (x2-x1)*(y2-y1) / 262144.0e0 < 0.001e0 THEN 'area_below_minimum'
  WHEN (x2-x1)*(y2-y1) / 262144.0e0 > 0.5e0 THEN 'area_above_maximum' END AS failed FROM clipped),
placed AS (SELECT auto_mask_id, category, defect, description, s, failed, CASE WHEN failed IS NULL THEN x1 ELSE 0 END AS x1, CASE WHEN failed IS NULL THEN y1 ELSE 0 END AS y1,
  CASE WHEN failed IS NULL THEN x2 ELSE 512 END AS x2, CASE WHEN failed IS NULL THEN y2 ELSE 512 END AS y2, replace(lower(category || ' ' || defect || ' ' || description), '-', '_') AS t,
  lower(category || ' ' || defect || ' ' || description) AS raw, lower(description) AS hint FROM judged)
"""
_CANDIDATES = f"""
entries AS (SELECT auto_mask_id, s, unnest(map_entries(s.candidate_scores)) AS e FROM placed),
qced AS (SELECT auto_mask_id, {_sql_alias('e.key', 'mode')} AS mode, CASE WHEN isnan(e.value) OR isinf(e.value) THEN NULL ELSE e.value END AS score, s.candidate_qc[e.key] AS q FROM entries),
cand AS (SELECT auto_mask_id, mode, score, coalesce(q.mask_area, 0) AS area, coalesce(q.mask_to_qwen_box_fraction, 0) AS box, coalesce(q.component_count, 0) AS comps,
  coalesce(list_transform(list_filter(q.reasons, lambda x: x IS NOT NULL), lambda x: {_sql_alias('x', 'reason')}), []) AS why FROM qced),
stated AS (SELECT *, CASE WHEN area <= 0 THEN 'reject' WHEN len(why) > 0 THEN 'warning' ELSE 'pass' END AS status FROM cand),
normal AS (SELECT auto_mask_id, max(comps) AS normal_comps FROM cand WHERE mode = 'normal_anomaly' GROUP BY 1),
memory AS (SELECT auto_mask_id, max(box) AS memory_box FROM cand WHERE mode = 'patchcore_guided' GROUP BY 1),
shaped AS (SELECT p.*, coalesce(normal_comps, 0) AS normal_comps, coalesce(memory_box, 0) AS memory_box, greatest((x2-x1)::DOUBLE/(y2-y1), (y2-y1)::DOUBLE/(x2-x1)) AS aspect,
  {_has('hint', P.AREA_HINTS + P.MANY_HINTS)} AS hinted FROM placed p LEFT JOIN normal USING (auto_mask_id) LEFT JOIN memory USING (auto_mask_id)),
ruled AS (SELECT *, CASE WHEN defect = 'scratch' THEN CASE WHEN aspect >= 2.2 OR (normal_comps >= 3 AND NOT hinted) THEN '{P.BAND}' WHEN hinted THEN '{P.SCUFF}' ELSE '{P.STROKE}' END
  WHEN category = 'bottle' AND {_has('t', P.FOREIGN_WORDS)} THEN '{P.DIRT}' WHEN category = 'bottle' AND defect = 'broken_small' THEN '{P.CHIP}' WHEN category = 'bottle' AND {_has('t', P.CHIP_WORDS)} THEN '{P.RIM}'
  WHEN category = 'zipper' AND defect IN ('broken_teeth', 'split_teeth') THEN '{P.TOOTH}' WHEN category = 'zipper' AND defect = 'fabric_border' THEN '{P.FABRIC}' ELSE 'score_only' END AS policy FROM shaped),
gated AS (SELECT *, CASE WHEN failed IS NOT NULL THEN 'localization_not_valid' WHEN greatest(x2-x1, y2-y1) / 512.0e0 < 0.32e0 THEN 'region_already_local' WHEN least(1.0e0, memory_box * 8) < 0.88e0 THEN 'baseline_not_chain_spanning'
  WHEN least(1.0e0, memory_box * 4) < 0.25e0 THEN 'baseline_sparse_or_multi_local' ELSE 'dense_full_chain_overcoverage' END AS gate FROM ruled)
"""
_DELTAS = ", ".join(f"('{p}', '{m}', {d}::DOUBLE)" for p, of in P.MODE_DELTAS.items() for m, d in of.items())
_ADJUSTED = f"""
paired AS (SELECT c.*, policy, (x2-x1)*(y2-y1) / 262144.0e0 AS part FROM stated c JOIN gated USING (auto_mask_id)),
moved AS (SELECT b.*, CASE
    WHEN policy = '{P.CHIP}' AND mode = 'sam2_heatmap' THEN CASE WHEN box > 0.45 OR list_contains(why, 'large_fraction_of_qwen_box') THEN -0.8 WHEN comps > 24 THEN -0.2 ELSE 0 END
    WHEN policy = '{P.CHIP}' AND mode = 'polar_rim_residual' THEN CASE WHEN box > 0.24 THEN -0.75 ELSE 0 END + -0.3
    WHEN policy = '{P.FABRIC}' AND mode = 'sam2_heatmap' THEN CASE WHEN list_contains(why, 'tiny_fraction_of_qwen_box') THEN -0.35 ELSE 0 END + CASE WHEN box < 0.004 AND part > 0.5 THEN -0.55 ELSE 0 END
      + CASE WHEN box >= 0.16 AND box <= 0.36 THEN 0.18 ELSE 0 END
    WHEN policy = '{P.FABRIC}' AND mode = 'patchcore_guided' AND (list_contains(why, 'large_image_area') OR list_contains(why, 'touches_image_border')) THEN -0.15
    WHEN policy = '{P.FABRIC}' AND mode = 'normal_residual_fusion' AND part >= 0.5 THEN -0.15 ELSE 0 END::DOUBLE
  + CASE WHEN policy = '{P.SCUFF}' THEN CASE mode WHEN 'nearest_normal_residual' THEN 0.34 + CASE WHEN box > 0.2 THEN -0.18 ELSE 0 END + CASE WHEN comps > 12 THEN -0.12 ELSE 0 END
      WHEN 'patchcore_guided' THEN 0.42 + CASE WHEN box > 0.18 THEN -0.16 ELSE 0 END + CASE WHEN comps > 18 THEN -0.12 ELSE 0 END
      WHEN 'normal_residual_fusion' THEN 0.46 + CASE WHEN box > 0.2 THEN -0.16 ELSE 0 END + CASE WHEN comps > 36 THEN -0.18 ELSE 0 END
      WHEN 'scuff_cluster' THEN 0.34 WHEN 'fft_texture_suppression' THEN 0.32 + CASE WHEN box > 0.22 THEN -0.45 ELSE 0 END WHEN 'soft_patch' THEN 0.22 WHEN 'normal_anomaly' THEN 0.12 ELSE 0 END
    WHEN policy = '{P.BAND}' THEN CASE mode WHEN 'scratch_band_clean' THEN 0.28 WHEN 'normal_residual_fusion' THEN 0.1 WHEN 'nearest_normal_residual' THEN 0.1 WHEN 'patchcore_guided' THEN 0.06
      WHEN 'normal_anomaly' THEN 0.08 ELSE 0 END + CASE WHEN comps > 8 THEN -0.18 ELSE 0 END
    WHEN policy = '{P.STROKE}' AND mode IN ('normal_anomaly', 'nearest_normal_residual', 'patchcore_guided', 'normal_residual_fusion') THEN 0.08 ELSE 0 END::DOUBLE AS more FROM paired b),
own AS (SELECT m.*, round_even(greatest(-1.0e0, least(1.5e0, coalesce(score, -1.0e0) + coalesce(delta, 0.0e0) + more)), 4) AS moved_score
  FROM moved m LEFT JOIN (VALUES {_DELTAS}) d(policy, mode, delta) USING (policy, mode)),
best AS (SELECT auto_mask_id, max(moved_score) AS top FROM own WHERE mode <> 'ensemble_consensus' GROUP BY 1),
adj AS (SELECT o.*, CASE WHEN mode <> 'ensemble_consensus' THEN moved_score
  WHEN policy = '{P.DIRT}' THEN round_even(greatest(-1.0e0, least(1.5e0, moved_score - 0.4e0)), 4) WHEN policy = '{P.CHIP}' THEN round_even(greatest(-1.0e0, least(1.5e0, moved_score - 0.1e0)), 4)
  WHEN policy IN ('{P.RIM}', '{P.TOOTH}') THEN round_even(greatest(-1.0e0, least(1.5e0, moved_score - 0.05e0)), 4) WHEN policy = '{P.FABRIC}' THEN round_even(greatest(-1.0e0, least(1.5e0, moved_score + 0.05e0)), 4)
  WHEN policy = '{P.SCUFF}' THEN coalesce(top - 0.03e0, moved_score) ELSE coalesce(top + 0.2e0, moved_score) END AS adjusted FROM own o LEFT JOIN best USING (auto_mask_id))
"""
_ORDER = ", ".join(f"('{m}', {i})" for i, m in enumerate(P.HIERARCHY))


@query(
    f"""WITH s AS (SELECT sample_id, coalesce(any_value(category), '') AS c, coalesce(any_value(defect_type), '') AS d FROM anomaly_samples WHERE sample_id IS NOT NULL GROUP BY 1),
x AS (SELECT sample_id, replace(lower(c || ' ' || d || ' '), '-', '_') AS t, replace(lower(d || ' '), '-', '_') AS u FROM s)
SELECT sample_id, {_STRUCTURE} AS structure, CASE WHEN {_has('u', ('micro', 'tiny', 'pinpoint'))} THEN 'micro' WHEN {_has('u', ('small',))} THEN 'small' WHEN {_has('u', ('large', 'broad', 'wide'))} THEN 'large' ELSE 'unknown' END AS scale FROM x"""
)
def structure_profiles(spark, sf_dir):
    """Structure and scale the words of a sample speak of."""
    rows = R.once(table(spark, sf_dir, "anomaly_samples"), "sample_id", "category", "defect_type")
    nothing = F.lit("")
    return rows.select("sample_id", P.structure_profile(F.col("category"), F.col("defect_type"), nothing).alias("structure"), P.structure_scale(F.col("defect_type"), nothing).alias("scale"))


@query(f"SELECT doc_id, {_STRUCTURE} AS profile FROM (SELECT doc_id, replace(lower('  ' || coalesce(text, '')), '-', '_') AS t FROM documents)")
def keyword_profile(spark, sf_dir):
    """What kind of structure each text speaks of."""
    return table(spark, sf_dir, "documents").select("doc_id", P.structure_profile(F.lit(""), F.lit(""), F.col("text")).alias("profile"))


#: Structures and scales a specialist is made for; no scales means any. Fixed values.
SPECIALISTS = (("repeated_chain_refiner", ("repeated_chain",), ()), ("polar_rim_residual", ("ring_sector",), ("micro", "small")), ("zipper_fabric_border_layout", ("edge_border",), ()))


@query(
    f"""WITH s AS (SELECT sample_id, {_sql_alias("coalesce(any_value(category), '')", 'category')} AS c, {_sql_alias("coalesce(any_value(defect_type), '')", 'defect')} AS d FROM anomaly_samples WHERE sample_id IS NOT NULL GROUP BY 1),
x AS (SELECT sample_id, replace(lower(c || ' ' || d || ' '), '-', '_') AS t, replace(lower(d || ' '), '-', '_') AS u FROM s),
p AS (SELECT sample_id, {_STRUCTURE} AS structure, {_has('u', ('micro', 'tiny', 'small', 'pinpoint', 'broken_small'))} AS fine FROM x)
SELECT sample_id, list_filter([CASE WHEN structure = 'repeated_chain' THEN 'repeated_chain_refiner' END, CASE WHEN structure = 'ring_sector' AND fine THEN 'polar_rim_residual' END,
  CASE WHEN structure = 'edge_border' THEN 'zipper_fabric_border_layout' END], lambda m: m IS NOT NULL) AS specialists FROM p"""
)
def specialist_applicability(spark, sf_dir):
    """Which specialists apply to each sample."""
    rows = R.once(table(spark, sf_dir, "anomaly_samples"), "sample_id", "category", "defect_type")
    category, defect, nothing = normalised(F.coalesce("category", F.lit("")), "category"), normalised(F.coalesce("defect_type", F.lit("")), "defect"), F.lit("")
    structure, scale = P.structure_profile(category, defect, nothing), P.structure_scale(defect, nothing)
    fits = [F.when(structure.isin(*structures) & (scale.isin(*scales) if scales else F.lit(True)), mode) for mode, structures, scales in SPECIALISTS]
    return rows.select("sample_id", F.array_compact(F.array(*fits)).alias("specialists"))


@query(f"WITH {_IMAGES}, {_CANDIDATES} SELECT auto_mask_id, policy, gate, CASE WHEN defect <> 'scratch' THEN 'not_scratch' WHEN aspect >= 2.2 OR (normal_comps >= 3 AND NOT hinted) THEN 'scratch_band' WHEN hinted THEN 'multi_scuff' ELSE 'single_stroke' END AS morphology FROM gated")
def selection_policies(spark, sf_dir):
    """Policy of every image, and what the chain gate says of it."""
    return images(spark, sf_dir).select("auto_mask_id", "policy", F.col("why").alias("gate"), P.scratch_morphology(F.col("policy")).alias("morphology"))


@query(f"WITH {_IMAGES}, {_CANDIDATES}, {_ADJUSTED} SELECT auto_mask_id, mode, policy, status, round(adjusted, 6) AS adjusted FROM adj")
def policy_adjusted_scores(spark, sf_dir):
    """Candidate scores after the policy of their image."""
    rows = adjusted_images(spark, sf_dir).select("auto_mask_id", "policy", F.explode(F.arrays_zip("candidates", "adjusted")).alias("z"))
    return rows.select("auto_mask_id", "z.candidates.mode", "policy", "z.candidates.status", F.round("z.adjusted.adjusted", 6).alias("adjusted"))


def _valid(rows: DataFrame) -> DataFrame:
    """Only candidates with a mask, not refused and not below 0."""
    both = F.filter(F.arrays_zip("candidates", "adjusted"), lambda z: (z["candidates"]["mask_area"] > 0) & (z["candidates"]["status"] != "reject") & (z["adjusted"]["adjusted"] >= 0))
    rows = _once(rows, both=both)
    rows = _once(rows, candidates=F.transform("both", lambda z: z["candidates"]), adjusted=F.transform("both", lambda z: z["adjusted"]))
    return _once(rows, chosen=P.best_mode(F.col("adjusted")))


_REGION = "(y2-y1) / 512.0e0"


@query(
    f"""WITH {_IMAGES}, {_CANDIDATES}, {_ADJUSTED},
valid AS (SELECT a.*, coalesce(-h.place, -{len(P.HIERARCHY)}) AS place FROM adj a LEFT JOIN (VALUES {_ORDER}) h(mode, place) USING (mode) WHERE area > 0 AND status <> 'reject' AND adjusted >= 0),
pick AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY auto_mask_id ORDER BY adjusted DESC, place DESC, mode DESC) = 1),
ens AS (SELECT auto_mask_id, any_value(area) AS area, any_value(box) AS box, any_value(comps) AS comps, any_value(status) AS status FROM valid WHERE mode = 'ensemble_consensus' GROUP BY 1),
nrf AS (SELECT auto_mask_id, any_value(area) AS area, any_value(box) AS box, any_value(why) AS why FROM valid WHERE mode = 'normal_residual_fusion' GROUP BY 1),
pol AS (SELECT auto_mask_id, any_value(box) AS box, any_value(comps) AS comps, any_value(status) AS status FROM valid WHERE mode = 'polar_rim_residual' GROUP BY 1),
tested AS (SELECT p.auto_mask_id, p.mode, CASE
  WHEN p.policy = '{P.CHIP}' AND p.mode = 'sam2_heatmap' AND pol.box BETWEEN 0.02 AND 0.045 AND p.box >= 0.1 AND pol.comps <= 3 AND pol.status = 'pass' THEN 'compact_polar_rim_chip_over_broad_sam'
  WHEN p.policy = '{P.TOOTH}' AND p.mode = 'patchcore_guided' AND {_REGION} <= 0.45 AND p.comps <= 2 AND ens.comps <= 2 AND ens.area::DOUBLE / p.area BETWEEN 0.85 AND 1.2 AND ens.status = 'pass' THEN 'local_tooth_consensus_matches_patchcore_extent'
  WHEN p.policy = '{P.TOOTH}' AND p.mode = 'patchcore_guided' AND (y1 <= 0 OR y2 >= 512) AND nrf.area >= floor(p.area * 1.1e0) AND nrf.box <= 0.14 AND list_contains(nrf.why, 'touches_image_border') THEN 'edge_split_teeth_preserve_normal_residual_recall'
  WHEN p.policy = '{P.FABRIC}' AND p.mode = 'sam2_heatmap' AND list_contains(p.why, 'touches_image_border') AND ens.area::DOUBLE / p.area BETWEEN 0.65 AND 0.92 AND ens.box <= 0.3 AND ens.comps <= p.comps THEN 'border_touching_sam_prefers_compact_consensus'
  ELSE 'score_selection' END AS reason FROM pick p JOIN placed USING (auto_mask_id) LEFT JOIN ens USING (auto_mask_id) LEFT JOIN nrf USING (auto_mask_id) LEFT JOIN pol USING (auto_mask_id))
SELECT auto_mask_id, mode AS first_mode, CASE reason WHEN 'score_selection' THEN mode WHEN 'compact_polar_rim_chip_over_broad_sam' THEN 'polar_rim_residual' WHEN 'edge_split_teeth_preserve_normal_residual_recall' THEN 'normal_residual_fusion'
  ELSE 'ensemble_consensus' END AS mode, reason FROM tested"""
)
def chosen_candidate(spark, sf_dir):
    """The candidate taken for every image: the best valid one, or the one the arbitration puts in its place."""
    rows = _valid(adjusted_images(spark, sf_dir)).filter("chosen is not null")
    done = _once(rows, a=P.arbitrated("candidates", "chosen", "policy", "region", "size", "met", "why")).withColumnRenamed("chosen", "first_mode")
    return done.select("auto_mask_id", "first_mode", "a.mode", "a.reason")


@query(
    f"""WITH {_IMAGES}, {_CANDIDATES}, {_ADJUSTED},
pick AS (SELECT auto_mask_id, score FROM adj a LEFT JOIN (VALUES {_ORDER}) h(mode, place) USING (mode) QUALIFY row_number() OVER (PARTITION BY auto_mask_id ORDER BY adjusted DESC, coalesce(-h.place, -{len(P.HIERARCHY)}) DESC, mode DESC) = 1),
top AS (SELECT auto_mask_id, max(coalesce(score, -1.0e0)) AS oracle FROM adj GROUP BY 1)
SELECT auto_mask_id, round(oracle, 6) AS oracle, round(coalesce(score, -1.0e0), 6) AS chosen, round(greatest(0.0e0, oracle - coalesce(score, -1.0e0)), 6) AS regret FROM top JOIN pick USING (auto_mask_id)"""
)
def oracle_regret(spark, sf_dir):
    """What choosing by adjusted score lost against the best raw score."""
    rows = _once(adjusted_images(spark, sf_dir), mode=P.best_mode(F.col("adjusted"))).filter("mode is not null")
    best = F.array_max(F.transform("candidates", lambda c: F.coalesce(c["score"], F.lit(-1.0))))
    chosen = F.coalesce(F.get(F.filter("candidates", lambda c: c["mode"] == F.col("mode")), F.lit(0))["score"], F.lit(-1.0))
    rows = rows.select("auto_mask_id", best.alias("oracle"), chosen.alias("chosen"))
    return rows.select("auto_mask_id", F.round("oracle", 6).alias("oracle"), F.round("chosen", 6).alias("chosen"), F.round(F.greatest(F.lit(0.0), F.col("oracle") - F.col("chosen")), 6).alias("regret"))


@query(f"WITH {_IMAGES} SELECT auto_mask_id, [x1, y1, x2, y2]::INTEGER[] AS region, CASE WHEN failed IS NULL THEN 'valid' ELSE 'fallback' END AS status, failed AS reason FROM placed")
def validated_regions(spark, sf_dir):
    """Regions inside their image, or the whole image and why."""
    return images(spark, sf_dir).select("auto_mask_id", "region", "placed.status", "placed.reason")


@query(
    f"""WITH {_IMAGES}, m AS (SELECT *, coalesce(CASE WHEN isnan(s.candidate_scores['residual']) OR isinf(s.candidate_scores['residual']) THEN NULL ELSE s.candidate_scores['residual'] END, 0) * 0.4e0 AS repeated,
  coalesce(CASE WHEN isnan(s.candidate_scores['polar_ring']) OR isinf(s.candidate_scores['polar_ring']) THEN NULL ELSE s.candidate_scores['polar_ring'] END, 0) * 1.5e0 AS rim,
  defect IN ('broken_teeth', 'split_teeth') OR {_has('raw', P.TOOTH_HINTS)} AS tooth,
  failed IS NULL AND (x2-x1)*(y2-y1) / 262144.0e0 BETWEEN 0.0001 AND 0.72 AND greatest((x2-x1)::DOUBLE/(y2-y1), (y2-y1)::DOUBLE/(x2-x1)) <= 25 AS sane FROM placed)
SELECT auto_mask_id, sane, CASE WHEN {_has('raw', P.FABRIC_HINTS)} AND NOT tooth THEN 'qwen_bbox'
  WHEN contains(raw, 'zipper') OR contains(raw, 'teeth') OR ((contains(raw, 'tooth') OR contains(raw, 'interlock')) AND repeated >= 0.2) THEN CASE WHEN tooth THEN 'normal_guided_qwen_verify' ELSE 'qwen_bbox' END
  WHEN (contains(raw, 'bottle') OR rim >= 1.15) AND {_has('raw', P.FOREIGN_WORDS)} THEN 'bottle_surface_guided' WHEN (contains(raw, 'bottle') OR rim >= 1.15) AND {_has('raw', P.CHIP_WORDS)} THEN 'bottle_rim_guided_qwen'
  WHEN NOT sane AND repeated >= 0.2 THEN 'normal_guided_qwen_verify' ELSE 'qwen_bbox' END AS route FROM m"""
)
def localisation_routes(spark, sf_dir):
    """How each image's region is to be found; repeated texture and rim are stood for by two candidates' scores."""
    rows = images(spark, sf_dir)
    score = lambda mode: F.coalesce(P.candidate_of(F.col("candidates"), mode)["score"], F.lit(0.0))
    rows = rows.withColumn("sane", P.box_is_sane(F.col("placed.status"), F.col("region"), SIZE, SIZE))
    route = P.localisation_policy(F.col("category"), F.col("defect"), F.col("description"), score("residual") * 0.4, score("polar_rim_residual") * 1.5, F.col("sane"))
    return rows.select("auto_mask_id", "sane", route.alias("route"))


@query(
    r"""WITH one AS (SELECT DISTINCT line_id, replace(payload, '"region_xyxy"', '"bbox_xyxy"') AS payload FROM raw_record_lines WHERE line_id IS NOT NULL AND record_type = 'auto_mask'),
read AS (SELECT line_id, payload, CASE WHEN json_valid(trim(regexp_extract(payload, '(?s)\{.*\}'))) AND payload LIKE '%{%}%' THEN regexp_extract(payload, '(?s)\{.*\}') END AS j,
  regexp_extract(payload, '"?bbox_xyxy"?\s*:\s*\[([^\]]+)\]', 1) AS torn FROM one),
boxes AS (SELECT line_id, payload, j, CASE WHEN j IS NOT NULL THEN coalesce(json_extract(j, '$.bbox_xyxy'), json_extract(j, '$.bbox'), json_extract(j, '$.box'), json_extract(j, '$.region')) END AS given,
  list_transform(regexp_extract_all(torn, '-?\d+(?:\.\d+)?'), lambda v: v::DOUBLE) AS torn FROM read),
four AS (SELECT line_id, payload, j, CASE WHEN j IS NULL THEN torn WHEN json_type(given) = 'ARRAY' THEN TRY_CAST(given AS DOUBLE[]) END AS b FROM boxes)
SELECT line_id, CASE WHEN list_max(b) <= 1 THEN list_transform(b, lambda v: round_even(v * 512, 0)::INT) WHEN list_max(b) <= 1000 AND (b[3] > 512 * 1.2e0 OR b[4] > 512 * 1.2e0) THEN list_transform(b, lambda v: round_even(v / 1000 * 512, 0)::INT)
  ELSE list_transform(b, lambda v: round_even(v, 0)::INT) END AS bbox_xyxy, j IS NULL AS recovered,
  TRY_CAST(CASE WHEN j IS NULL THEN nullif(regexp_extract(payload, '"?confidence"?\s*:\s*(-?\d+(?:\.\d+)?)', 1), '') ELSE json_extract_string(j, '$.confidence') END AS DOUBLE) AS confidence
FROM four WHERE len(b) = 4 AND len(list_filter(b, lambda x: x IS NULL)) = 0"""
)
def answer_payloads(spark, sf_dir):
    """Boxes and confidences out of written lines, whole or torn; their region is what an answer calls its box."""
    text = F.replace("payload", F.lit('"region_xyxy"'), F.lit('"bbox_xyxy"')).alias("payload")
    lines = table(spark, sf_dir, "raw_record_lines").filter("line_id is not null and record_type = 'auto_mask'").select("line_id", text).distinct()
    rows = lines.select("line_id", F.explode(F.array(P.parsed_answer(F.col("payload"), SIZE, SIZE))).alias("a")).filter("a is not null")
    return rows.select("line_id", "a.bbox_xyxy", "a.recovered", "a.confidence")
