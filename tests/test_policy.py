"""Expected values are worked by hand from the formulas; none comes from the SQL of a query."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import policy as P

SCHEMA = f"id int, category string, defect string, description string, region array<int>, size array<int>, candidates array<{P.CANDIDATE}>, gate boolean, gate_reason string"


def cand(mode, score=0.5, area=1000, box=0.1, img=0.01, comps=3, reasons=(), status="pass", **parameters):
    return (mode, score, area, box, img, comps, list(reasons), status, {k: float(v) for k, v in parameters.items()})


def frame(spark, *rows):
    made = []
    for i, r in enumerate(rows):
        made.append((i, r.get("category", "wood"), r.get("defect", "stain"), r.get("description", ""), r.get("region", [10, 10, 90, 90]), r.get("size", [100, 100]),
                     r.get("candidates", []), r.get("gate", False), r.get("gate_reason", "")))
    return spark.createDataFrame(made, SCHEMA)


def policies(df):
    return df.withColumn("policy", P.selection_policy(F.col("category"), F.col("defect"), F.col("description"), F.col("region"), F.col("candidates")))


@pytest.mark.parametrize(
    "category,defect,description,want",
    [
        ("bottle", "broken_large", "large broken rim area", "ring_sector"), ("bottle", "contamination", "surface stain", "flat_surface_patch"),
        ("zipper", "broken_teeth", "missing tooth in zipper chain", "repeated_chain"), ("zipper", "fabric_border", "frayed edge beside zipper", "edge_border"),
        ("wood", "scratch", "thin linear scratch", "thin_linear"), ("bottle", "contamination", None, "flat_surface_patch"), ("wood", "edge", "", "unknown"),
        ("felt", "rub", "", "multi_scuff"), ("tile", "spot", "", "flat_surface_patch"), (None, None, None, "unknown"), ("wood", "Side-Band border", "", "edge_border"),
    ],
)
def test_structures(spark, category, defect, description, want):
    row = spark.createDataFrame([(category, defect, description)], "c string, d string, t string")
    assert row.select(P.structure_profile(F.col("c"), F.col("d"), F.col("t"))).first()[0] == want


def test_scales(spark):
    rows = [("broken_small", "", "small"), ("broken_small", "pinpoint", "micro"), ("broken_large", "", "large"), ("x", "wide", "large"), (None, None, "unknown")]
    df = spark.createDataFrame(rows, "d string, t string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", P.structure_scale(F.col("d"), F.col("t"))).collect())


def test_policies_by_target(spark):
    rows = [
        ({"category": "bottle", "defect": "contamination"}, P.DIRT), ({"category": "bottle", "defect": "broken_small"}, P.CHIP),
        ({"category": "bottle", "defect": "broken_small", "description": "a spot"}, P.DIRT), ({"category": "bottle", "defect": "broken_large"}, P.RIM),
        ({"category": "zipper", "defect": "split_teeth"}, P.TOOTH), ({"category": "zipper", "defect": "fabric_border"}, P.FABRIC), ({"category": "zipper", "defect": "rough"}, P.SCORE_ONLY),
        ({"category": "bottle", "defect": None}, P.SCORE_ONLY), ({"defect": "scratch", "region": [0, 0, 90, 30]}, P.BAND), ({"defect": "scratch"}, P.STROKE),
        ({"defect": "scratch", "description": "several scratches"}, P.SCUFF), ({"defect": "scratch", "candidates": [cand("normal_anomaly", comps=3)]}, P.BAND),
        ({"defect": "scratch", "description": "worn", "candidates": [cand("normal_anomaly", comps=9)]}, P.SCUFF), ({"category": None, "defect": None, "description": None}, P.SCORE_ONLY),
    ]
    got = [r.policy for r in policies(frame(spark, *[r for r, _ in rows])).orderBy("id").collect()]
    assert got == [w for _, w in rows]


def test_adjusted_scores(spark):
    chip = {"category": "bottle", "defect": "broken_small"}
    tooth = {"category": "zipper", "defect": "split_teeth"}
    fabric = {"category": "zipper", "defect": "fabric_border"}
    scuff, band = {"defect": "scratch", "description": "several"}, {"defect": "scratch", "region": [0, 0, 90, 30]}
    cases = [
        (chip, cand("sam2_heatmap", 0.3, box=0.46), 0.45), (chip, cand("sam2_heatmap", 0.3, box=0.1, comps=25), 1.05), (chip, cand("sam2_heatmap", 0.9), 1.5),
        (chip, cand("sam_prompt_regularized", 0.1, reasons=["large_fraction_of_qwen_box"], comps=30), -0.05),
        (chip, cand("polar_rim_residual", 0.5, polar_rim_sector_degrees=30), 0.9), (chip, cand("polar_rim_residual", 0.5), 0.5), (chip, cand("polar_rim_residual", 0.5, box=0.3, polar_rim_sector_degrees=70), 0.05),
        (chip, cand("foundation_anomaly_field", 0.5, box=0.4, comps=40), 0.2), (chip, cand("foundation_anomaly_field", 0.5, foundation_region_contrast=0.3), 0.734), (chip, cand("foundation_anomaly_field", 0.5, foundation_region_contrast=0.9), 0.78),
        (tooth, cand("repeated_chain_refiner", 0.5, repeated_chain_explanation_score=0.5, repeated_chain_structure_score=0.5, repeated_chain_vertical_span_fraction=0.4), 0.41),
        ({**tooth, "gate": True}, cand("repeated_chain_refiner", 0.5), 0.63), (tooth, cand("patchcore_guided", 0.5), 0.95), (tooth, cand("fft_texture_suppression", 0.1), -0.1),
        (fabric, cand("sam2_heatmap", 0.2, box=0.2), 1.03), (fabric, cand("sam2_heatmap", 0.2, box=0.003, reasons=["tiny_fraction_of_qwen_box"]), -0.05),
        (fabric, cand("musc_mutual_score", 0.5, box=0.1), 0.15), (fabric, cand("patchcore_guided", 0.5, reasons=["touches_image_border"]), 0.45),
        (fabric, cand("zipper_fabric_border_layout", 0.2), 1.0), ({**fabric, "region": [0, 0, 20, 100]}, cand("zipper_fabric_border_layout", 0.2), 0.3), (fabric, cand("normal_residual_fusion", 0.5), 0.35),
        (scuff, cand("foundation_anomaly_field", 0.5, box=0.25), 0.73), (scuff, cand("nearest_normal_residual", 0.5, box=0.21, comps=13), 0.54), (scuff, cand("normal_residual_fusion", 0.5, comps=40), 0.78),
        (scuff, cand("support_constrained_fusion", 0.5, support_constrained_reverted=1, support_constrained_rejected_grain=2), 0.84), (scuff, cand("structure_tensor_ridge", 0.5, box=0.01), 0.24),
        (scuff, cand("linear", 0.5, box=0.05), -1.0), (scuff, cand("linear", 0.5, box=0.08), 0.15), (scuff, cand("multi_linear", 0.5), 0.15),
        (band, cand("foundation_anomaly_field", 0.5, comps=9), 0.54), (band, cand("scratch_band_clean", 0.5), 0.78), (band, cand("pixel", 0.5, comps=9), 0.32),
        ({"defect": "scratch"}, cand("linear", 0.5), 0.58), ({}, cand("procedural", 0.5), 0.2), ({}, cand("pixel", None), -1.0), ({}, cand("residual", 0.12345), 0.1234),
    ]
    df = policies(frame(spark, *[{**row, "candidates": [c]} for row, c, _ in cases]))
    got = df.withColumn("a", P.adjusted_candidates("candidates", "policy", "region", "size", "gate")).orderBy("id").collect()
    for (row, c, want), r in zip(cases, got):
        assert r.a[0].adjusted == pytest.approx(want, abs=1e-9), (row, c, r.policy)


def test_foundation_bonus_is_scaled(spark):
    df = policies(frame(spark, {"category": "bottle", "defect": "broken_small", "candidates": [cand("foundation_anomaly_field", 0.5)]}))
    assert df.select(P.adjusted_candidates("candidates", "policy", "region", "size", "gate", 0.0).alias("a")).first().a[0].adjusted == 0.5


def test_ensemble_and_ties(spark):
    rows = [
        {"candidates": [cand("residual", 0.5), cand("ensemble_consensus", 0.1)]}, {"category": "bottle", "defect": "broken_small", "candidates": [cand("residual", 0.5), cand("ensemble_consensus", 0.9)]},
        {"candidates": [cand("pixel", 0.5), cand("soft_patch", 0.5), cand("unheard", 0.5)]}, {"candidates": []},
    ]
    df = policies(frame(spark, *rows)).withColumn("a", P.adjusted_candidates("candidates", "policy", "region", "size", "gate"))
    df = df.withColumn("a", P.with_ensemble(F.col("a"), F.col("policy"))).withColumn("mode", P.best_mode(F.col("a")))
    got = df.orderBy("id").collect()
    assert {x.mode: x.adjusted for x in got[0].a} == {"residual": 0.5, "ensemble_consensus": 0.7}
    assert {x.mode: x.adjusted for x in got[1].a} == {"residual": 0.5, "ensemble_consensus": 0.7}  # 0.9 - 0.1 by the policy, - 0.1 on top
    assert [r.mode for r in got] == ["ensemble_consensus", "ensemble_consensus", "soft_patch", None]


CASES = [
    ("polar", P.CHIP, [10, 10, 90, 90], [100, 100], [cand("sam_prompt_regularized", area=13000, box=0.13, comps=4), cand("polar_rim_residual", area=3500, box=0.033, comps=2)],
     "sam_prompt_regularized", "polar_rim_residual", "compact_polar_rim_chip_over_broad_sam"),
    ("local tooth", P.TOOTH, [128, 272, 384, 480], [512, 512], [cand("patchcore_guided", area=7000, box=0.13, comps=1), cand("ensemble_consensus", area=7050, box=0.13, comps=1)],
     "patchcore_guided", "ensemble_consensus", "local_tooth_consensus_matches_patchcore_extent"),
    ("edge", P.TOOTH, [128, 0, 384, 288], [512, 512], [cand("patchcore_guided", area=7400, box=0.10, comps=2),
     cand("normal_residual_fusion", area=8850, box=0.12, comps=33, status="warning", reasons=["touches_image_border", "many_components"])],
     "patchcore_guided", "normal_residual_fusion", "edge_split_teeth_preserve_normal_residual_recall"),
    ("long tooth", P.TOOTH, [180, 0, 330, 512], [512, 512], [cand("patchcore_guided", area=10000, box=0.16, comps=2), cand("zipper_tooth_agreement", area=8200, box=0.13, comps=2)],
     "patchcore_guided", "zipper_tooth_agreement", "long_tooth_region_patchcore_musc_agreement"),
    ("fabric", P.FABRIC, [0, 0, 1, 1], [100, 100], [cand("sam2_heatmap", area=8800, box=0.30, comps=3, status="warning", reasons=["touches_image_border"]),
     cand("ensemble_consensus", area=7200, box=0.24, comps=1, status="warning", reasons=["touches_image_border"])],
     "sam2_heatmap", "ensemble_consensus", "border_touching_sam_prefers_compact_consensus"),
    ("dirt", P.DIRT, [0, 0, 1, 1], [100, 100], [cand("fft_texture_suppression", area=28648, box=0.38, comps=1, status="warning", reasons=["large_image_area"]),
     cand("bottle_contamination_recall_fusion", area=45098, box=0.59, comps=10, status="warning", reasons=["large_image_area", "large_fraction_of_qwen_box"])],
     "fft_texture_suppression", "bottle_contamination_recall_fusion", "broad_fft_uses_coherent_sam_recall_fusion"),
    ("polar too wide", P.CHIP, [10, 10, 90, 90], [100, 100], [cand("sam2_heatmap", area=13000, box=0.13), cand("polar_rim_residual", area=3500, box=0.046)], "sam2_heatmap", "sam2_heatmap", "score_selection"),
    ("nothing else", P.CHIP, [10, 10, 90, 90], [100, 100], [cand("sam2_heatmap")], "sam2_heatmap", "sam2_heatmap", "score_selection"),
    ("other policy", P.SCORE_ONLY, [180, 0, 330, 512], [512, 512], [cand("patchcore_guided", area=10000), cand("zipper_tooth_agreement", area=8200)], "patchcore_guided", "patchcore_guided", "score_selection"),
]


def test_overrides(spark):
    rows = [(i, p, r, s, c, m, False, "") for i, (_, p, r, s, c, m, _, _) in enumerate(CASES)]
    rows.append((len(rows), P.TOOTH, [0, 0, 1, 1], [100, 100], [cand("patchcore_guided"), cand("repeated_chain_refiner")], "patchcore_guided", True, P.GATE_MET))
    df = spark.createDataFrame(rows, f"id int, policy string, region array<int>, size array<int>, candidates array<{P.CANDIDATE}>, chosen string, gate boolean, why string")
    got = df.select("id", P.arbitrated("candidates", "chosen", "policy", "region", "size", "gate", "why").alias("a")).orderBy("id").collect()
    for case, r in zip(CASES, got):
        assert (r.a.mode, r.a.reason) == case[6:], case[0]
    assert (got[-1].a.mode, got[-1].a.reason, got[-1].a.applied) == ("repeated_chain_refiner", P.GATE_MET, True)


def test_gate(spark):
    rows = [("valid", 0.5, 0.9, 0.3, P.GATE_MET), ("fallback", 0.5, 0.9, 0.3, P.GATE_UNPLACED), ("valid", 0.3, 0.1, 0.1, "region_already_local"), ("valid", 0.32, 0.87, 0.1, "baseline_not_chain_spanning"),
            ("valid", 0.5, 0.88, 0.24, "baseline_sparse_or_multi_local"), (None, None, None, None, P.GATE_UNPLACED)]
    df = spark.createDataFrame(rows, "s string, a double, b double, c double, want string").withColumn("g", P.chain_gate(F.col("s"), F.col("a"), F.col("b"), F.col("c")))
    assert all(r.g.reason == r.want and r.g.enabled == (r.want == P.GATE_MET) for r in df.collect())


def test_localisation_routes(spark):
    rows = [
        ("zipper", "broken_teeth", "one or more zipper teeth are broken or missing", 0.5, 0.0, True, "normal_guided_qwen_verify"),
        ("zipper", "fabric_border", "frayed damaged fabric border beside the zipper teeth", 0.5, 0.0, True, "qwen_bbox"),
        ("bottle", "broken_small", "small chipped missing glass on the bottle rim", 0.0, 0.0, True, "bottle_rim_guided_qwen"),
        ("bottle", "contamination", "visible contamination stain or foreign material on the bottle surface", 0.0, 0.0, True, "bottle_surface_guided"),
        ("zipper", "rough", "", 0.0, 0.0, True, "qwen_bbox"), ("chain", "tooth gone", "", 0.1, 0.0, True, "qwen_bbox"), ("chain", "split tooth", "", 0.3, 0.0, True, "normal_guided_qwen_verify"),
        ("vial", "chip", "", 0.0, 1.2, True, "bottle_rim_guided_qwen"), ("felt", "hole", "", 0.25, 0.0, False, "normal_guided_qwen_verify"), (None, None, None, None, None, None, "qwen_bbox"),
    ]
    df = spark.createDataFrame(rows, "c string, d string, t string, r double, m double, s boolean, want string")
    got = df.withColumn("got", P.localisation_policy(F.col("c"), F.col("d"), F.col("t"), F.col("r"), F.col("m"), F.col("s"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_regions(spark):
    rows = [([10, 10, 60, 60], [10, 10, 60, 60], "valid", None), ([-5, 2, 30, 200], [0, 2, 30, 100], "valid", None), ([5, 5, 5, 9], [0, 0, 100, 100], "fallback", "empty_after_clipping"),
            ([5, 5, 7, 8], [0, 0, 100, 100], "fallback", "area_below_minimum"), ([0, 0, 100, 90], [0, 0, 100, 100], "fallback", "area_above_maximum"),
            ([1, 2, 3], [0, 0, 100, 100], "fallback", "no_box"), (None, [0, 0, 100, 100], "fallback", "no_box"), ([1, None, 3, 4], [0, 0, 100, 100], "fallback", "no_box")]
    df = spark.createDataFrame(rows, "b array<int>, region array<int>, status string, reason string").withColumn("v", P.validated_region(F.col("b"), 100, 100))
    for r in df.collect():
        assert (r.v.region, r.v.status, r.v.reason) == (r.region, r.status, r.reason)
    inset = df.limit(3).select(P.validated_region(F.lit(None).cast("array<int>"), 100, 50, fallback="center_inset").alias("v")).first().v
    assert inset.region == [4, 2, 96, 48]
    sane = spark.createDataFrame([("valid", [0, 0, 50, 50], True), ("valid", [0, 0, 90, 90], False), ("valid", [0, 0, 100, 2], False), ("fallback", [0, 0, 50, 50], False)], "s string, b array<int>, want boolean")
    assert all(r.got == r.want for r in sane.withColumn("got", P.box_is_sane(F.col("s"), F.col("b"), 100, 100)).collect())


def test_answers(spark):
    texts = [
        '{"bbox_xyxy": [0.1, 0.2, 0.8, 0.6], "defect_type": "crack", "confidence": 0.7, "evidence": "thin dark line"}',
        '```json\n{"bbox_xyxy": [10, 20, 90, 40], "defect_type": "scratch", "confidence": 0.9, "evidence": "visible scratch',
        'Sure: {"box": [10, 10, 90, 40], "sub_regions": [[12, 20, 40, 30], [1, 2], [50, 30, 80, 40]], "confidence": "high"} done', "bbox: 1,2,3,4", '{"defect_type": "scratch"}', None, "",
        '{"region": [100, 200, 900, 600]}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("a", P.parsed_answer(F.col("t"), 100, 50))
    got = [r.a for r in df.orderBy("id").collect()]
    assert (got[0].bbox_xyxy, got[0].defect_type, got[0].confidence, got[0].recovered) == ([10, 10, 80, 30], "crack", 0.7, False)
    assert (got[1].bbox_xyxy, got[1].defect_type, got[1].confidence, got[1].evidence, got[1].recovered) == ([10, 20, 90, 40], "scratch", 0.9, "visible scratch", True)
    assert (got[2].bbox_xyxy, got[2].sub_boxes_xyxy, got[2].confidence) == ([10, 10, 90, 40], [[12, 20, 40, 30], [50, 30, 80, 40]], None)
    assert got[3] is got[4] is got[5] is got[6] is None and got[7].bbox_xyxy == [10, 10, 90, 30]


def _generated(spark, *rows):
    schema = ("id int, quality double, vis double, bg double, out double, inp double, flags int, morph string, profile string, "
              "critic struct<tfidg_lite_score: double, adaptive_mask_coverage_score: double, adaptive_mask_coverage_fraction: double>, repaired boolean")  # fmt: skip
    base = {"quality": 0.2, "vis": 0.03, "bg": 0.01, "out": 0.1, "inp": 0.1, "flags": 0, "morph": "patch", "profile": "p", "critic": (0.5, 0.6, 0.38), "repaired": False}
    df = spark.createDataFrame([(i, *{**base, **r}.values()) for i, r in enumerate(rows)], schema)
    return df, P.Candidate(*[F.col(c) for c in ("quality", "vis", "bg", "out", "inp", "flags", "morph", "profile", "critic", "repaired")])


def test_refusals_in_order(spark):
    df, c = _generated(spark, {}, {"vis": 0.001, "flags": 2, "bg": 0.06, "out": 0.3, "inp": 0.21, "critic": None}, {"critic": (0.1, 0.1, 0.7)}, {"critic": (0.9, 0.9, 0.1)}, {"profile": "q"}, {"vis": 0.015})
    s = P.SelectorSettings(quality_filter=True, min_fraction=0.2, max_fraction=0.58, min_critic=0.3, preferred=(("patch", ("p",)),), reject_nonpreferred=True)
    got = [r.r for r in df.select("id", P.refusals(c, s).alias("r")).orderBy("id").collect()]
    assert got == [
        [], ["quality_filtered_training_failed", "quality_flags", "low_defect_visibility", "high_background_change", "high_outside_refined_change", "overbroad_inpaint_mask", "missing_tfidg_lite_metrics"],
        ["low_tfidg_mask_coverage", "high_tfidg_mask_coverage_fraction", "low_tfidg_lite_score"], ["low_tfidg_mask_coverage_fraction"], ["nonpreferred_morphology_profile"], [],
    ]


def test_selector_scores(spark):
    df, c = _generated(spark, {}, {"profile": "q"}, {"critic": (0.5, 0.6, 0.54)}, {"repaired": True}, {"critic": None}, {"flags": 2, "morph": None})
    s = P.SelectorSettings(balance_weight=0.12, fraction_tolerance=0.20, preferred=(("patch", ("p",)),), repaired_penalty=0.1)
    got = [r.s for r in df.select("id", P.selector_score(c, s).alias("s")).orderBy("id").collect()]
    base = 0.2 + 1.5 * 0.03 - 0.01 - 0.2 * 0.1 - 0.05 * 0.1
    assert got == pytest.approx([base + 0.04 + 0.175, base - 0.03 + 0.175, base + 0.04 + 0.175 - 0.12 * 0.8, base + 0.04 + 0.175 - 0.1, base + 0.04, base - 0.1 + 0.175])
