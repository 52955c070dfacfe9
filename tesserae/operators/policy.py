"""Which mask of an image to take: structure, selection policy, adjusted scores, arbitration, localisation.

All rules are tables of fixed values; operators only apply them, within a row,
without a shuffle: an image's candidates are an array of structs ``CANDIDATE``.

Defined cases: a null category, type or description is an empty text; a null
measure of a candidate counts as 0, a null status as pass; a candidate without
score has -1; an image without candidates has no choice (null).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.scalars import reasons, safe_number

CANDIDATE = (
    "struct<mode: string, score: double, mask_area: int, box_fraction: double, image_fraction: double, components: int, reasons: array<string>, status: string,"
    " parameters: map<string,double>>"
)

# --- fixed values: words -------------------------------------------------------------------------------------------

#: Structure of what a text speaks of: (class, any of these, and any of these, but none of these); the first that fits counts.
EDGE_WORDS = ("fabric_border", "border", "edge", "fray", "frayed", "side_band", "seam")
EDGE_CONTEXT = ("fabric", "fray", "border", "side_band", "seam", "zipper")
CHAIN_WORDS = ("zipper", "tooth", "teeth", "chain", "periodic", "repeated", "split_teeth", "broken_teeth")
RING_WORDS = ("bottle", "rim", "annular", "circular_rim", "chip", "chipped", "broken_large", "broken_small", "glass")
DIRT_WORDS = ("contamination", "stain", "foreign", "spot", "surface", "dirty")
LINE_WORDS = ("scratch", "crack", "split", "line", "linear", "stroke")
SCUFF_WORDS = ("scuff", "smudge", "rub", "abrasion", "fuzzy")
PATCH_WORDS = ("contamination", "stain", "foreign", "spot", "surface", "patch")
STRUCTURES = (
    ("edge_border", EDGE_WORDS, EDGE_CONTEXT),
    ("repeated_chain", CHAIN_WORDS, ()),
    ("flat_surface_patch", RING_WORDS, DIRT_WORDS),
    ("ring_sector", RING_WORDS, ()),
    ("thin_linear", LINE_WORDS, ()),
    ("multi_scuff", SCUFF_WORDS, ()),
    ("flat_surface_patch", PATCH_WORDS, ()),
)
#: Scale of a defect, the first that fits.
SCALES = (
    ("micro", ("micro", "tiny", "pinpoint")),
    ("small", ("micro", "tiny", "small", "pinpoint", "broken_small")),
    ("large", ("large", "broad", "wide", "broken_large")),
)
#: Words of a description that speak of an area or of many marks.
AREA_HINTS = ("patch", "area", "scuff", "scuffed", "abrasion", "scraped", "rubbed", "wear", "worn", "surface damage")
MANY_HINTS = ("many", "multiple", "several", "a lot", "lots", "group", "cluster", "patch", "scratched area", "scratches",
              "scuff", "scuffed", "abrasion", "scraped")
#: Words the selection policies and the localisation router look for.
FOREIGN_WORDS = ("contamination", "stain", "foreign", "spot", "surface")
CHIP_WORDS = ("broken", "chip", "chipped", "missing", "rim", "glass")
FABRIC_HINTS = ("fabric_border", "fabric border", "fabric", "border", "woven", "frayed", "thread", "cloth")
TOOTH_HINTS = ("broken_teeth", "split_teeth", "broken tooth", "broken teeth", "missing tooth", "missing teeth", "split tooth", "split teeth",
               "separated tooth", "separated teeth", "interlock")
TOOTH_TYPES = ("broken_teeth", "split_teeth")

# --- fixed values: policies ----------------------------------------------------------------------------------------

DIRT, CHIP, RIM = "bottle_contamination_prefer_texture_or_sam", "bottle_small_chip_sam_gate", "bottle_rim_chip_prefer_normal_residual_sam_patchcore"
TOOTH, FABRIC = "zipper_tooth_chain_prefer_patchcore_normal_residual", "zipper_fabric_border_prefer_sam_patchcore_border_support"
SCORE_ONLY = "score_only"
BAND = "prefer_scratch_band_clean_normal_multi; penalize_detached_chunks"
SCUFF = "prefer_multi_scuff_fusion_scuff_cluster_soft_patch; block_undercovered_linear"
STROKE = "allow_line_like_candidates"
MORPHOLOGY = {BAND: "scratch_band", SCUFF: "multi_scuff", STROKE: "single_stroke"}

#: What a consensus of candidates gets on top, and whether it is scored by itself.
ENSEMBLE_BONUS = {DIRT: -0.40, CHIP: -0.10, RIM: -0.05, TOOTH: -0.05, FABRIC: 0.05, SCORE_ONLY: 0.20, BAND: 0.20, SCUFF: -0.03, STROKE: 0.20}
SCORED_BY_ITSELF = (DIRT, CHIP, RIM, TOOTH, FABRIC)

#: Change of score per policy and mode; those of the foundation field are scaled.
FOUNDATION = "foundation_anomaly_field"
MODE_DELTAS = {
    DIRT: {"fft_texture_suppression": 0.70, "sam2_heatmap": 0.65, "sam_prompt_regularized": 0.25, FOUNDATION: 0.22, "bottle_contamination_recall_fusion": 0.76,
           "musc_mutual_score": 0.15, "scuff_cluster": 0.20, "soft_patch": 0.15, "ensemble_consensus": -0.40, "scratch_band_clean": -0.30, "procedural": -0.30},
    CHIP: {"polar_rim_residual": 0.30, "sam2_heatmap": 0.95, "sam_prompt_regularized": 0.65, FOUNDATION: 0.18, "musc_mutual_score": 0.35,
           "nearest_normal_residual": 0.20, "patchcore_guided": 0.15, "normal_residual_fusion": 0.10, "ensemble_consensus": -0.10},
    RIM: {"nearest_normal_residual": 0.35, "sam2_heatmap": 0.35, "sam_prompt_regularized": 0.25, FOUNDATION: 0.22, "musc_mutual_score": 0.20,
          "patchcore_guided": 0.20, "normal_residual_fusion": 0.15, "ensemble_consensus": -0.05},
    TOOTH: {FOUNDATION: 0.26, "zipper_tooth_agreement": 0.12, "patchcore_guided": 0.45, "musc_mutual_score": 0.25, "normal_residual_fusion": 0.30,
            "nearest_normal_residual": 0.20, "sam_prompt_regularized": 0.18, "scratch_band_clean": 0.12, "ensemble_consensus": -0.05, "fft_texture_suppression": -0.20},
    FABRIC: {"sam2_heatmap": 0.65, "sam_prompt_regularized": 0.35, FOUNDATION: 0.18, "musc_mutual_score": 0.05, "patchcore_guided": 0.10,
             "nearest_normal_residual": 0.08, "ensemble_consensus": 0.05},
}

#: Further changes: (policies or morphology, modes, condition, change). Empty means any. In conditions and changes stand box and img (fractions of box and
#: image), comps, reason_<x>, p_<parameter>, region (share of the image), gate and full.
SAM = ("sam2_heatmap", "sam_prompt_regularized")
RULES = (
    # by policy
    ((TOOTH,), ("repeated_chain_refiner",), "gate", "0.48"),
    ((TOOTH,), ("repeated_chain_refiner",), "not gate", "-0.35"),
    ((FABRIC,), ("zipper_fabric_border_layout",), "full", "0.80"),
    ((FABRIC,), ("zipper_fabric_border_layout",), "not full", "0.10"),
    ((FABRIC,), ("normal_residual_fusion",), "full", "-0.15"),
    ((CHIP,), SAM, "box > 0.45 or img > 0.25 or reason_large_fraction_of_qwen_box", "-0.80"),
    ((CHIP,), SAM, "not (box > 0.45 or img > 0.25 or reason_large_fraction_of_qwen_box) and comps > 24", "-0.20"),
    ((), (FOUNDATION,), "box > 0.32 or img > 0.10", "-0.30"),
    ((), (FOUNDATION,), "comps > 32", "-0.18"),
    ((), (FOUNDATION,), "p_foundation_region_contrast >= 0.25", "least(0.10, p_foundation_region_contrast * 0.18)"),
    ((CHIP,), ("polar_rim_residual",), "box > 0.24 or img > 0.10", "-0.75"),
    ((CHIP,), ("polar_rim_residual",), "p_polar_rim_sector_degrees > 80", "-0.30"),
    ((CHIP,), ("polar_rim_residual",), "p_polar_rim_sector_degrees between 8 and 65", "0.10"),
    ((FABRIC,), SAM, "reason_tiny_fraction_of_qwen_box", "-0.35"),
    ((FABRIC,), SAM, "box < 0.004 and region > 0.50", "-0.55"),
    ((FABRIC,), SAM, "box between 0.16 and 0.36", "0.18"),
    ((FABRIC,), ("patchcore_guided",), "reason_large_image_area or reason_touches_image_border", "-0.15"),
    ((FABRIC,), ("musc_mutual_score",), "box < 0.16", "-0.40"),
    ((TOOTH,), ("repeated_chain_refiner",), "true", "0.18 * p_repeated_chain_explanation_score + 0.18 * p_repeated_chain_structure_score"),
    ((TOOTH,), ("repeated_chain_refiner",), "p_repeated_chain_vertical_span_fraction > 0.72", "-0.35"),
    ((TOOTH,), ("repeated_chain_refiner",), "p_repeated_chain_vertical_span_fraction <= 0.45", "0.08"),
    # many scuffs
    ((SCUFF,), (FOUNDATION,), "true", "0.30"),
    ((SCUFF,), (FOUNDATION,), "box > 0.22", "-0.12"),
    ((SCUFF,), (FOUNDATION,), "comps between 1 and 18", "0.05"),
    ((SCUFF,), ("nearest_normal_residual",), "true", "0.34"),
    ((SCUFF,), ("nearest_normal_residual",), "box > 0.20", "-0.18"),
    ((SCUFF,), ("nearest_normal_residual",), "comps > 12", "-0.12"),
    ((SCUFF,), ("patchcore_guided",), "true", "0.42"),
    ((SCUFF,), ("patchcore_guided",), "box > 0.18", "-0.16"),
    ((SCUFF,), ("patchcore_guided",), "comps > 18", "-0.12"),
    ((SCUFF,), ("normal_residual_fusion",), "true", "0.46"),
    ((SCUFF,), ("normal_residual_fusion",), "box > 0.20", "-0.16"),
    ((SCUFF,), ("normal_residual_fusion",), "comps > 36", "-0.18"),
    ((SCUFF,), ("multi_scuff_fusion",), "true", "0.44"),
    ((SCUFF,), ("support_constrained_fusion",), "true", "0.40"),
    ((SCUFF,), ("support_constrained_fusion",), "p_support_constrained_reverted <> 0", "-0.10"),
    ((SCUFF,), ("support_constrained_fusion",), "p_support_constrained_rejected_grain > 0", "0.04"),
    ((SCUFF,), ("scuff_cluster",), "true", "0.34"),
    ((SCUFF,), ("fft_texture_suppression",), "true", "0.32"),
    ((SCUFF,), ("fft_texture_suppression",), "box > 0.22", "-0.45"),
    ((SCUFF,), ("structure_tensor_ridge",), "true", "-0.10"),
    ((SCUFF,), ("structure_tensor_ridge",), "box < 0.05", "-0.16"),
    ((SCUFF,), ("soft_patch",), "true", "0.22"),
    ((SCUFF,), ("normal_anomaly",), "true", "0.12"),
    ((SCUFF,), ("linear", "multi_linear"), "true", "-0.35"),
    # a band of scratches
    ((BAND,), (FOUNDATION,), "true", "0.18"),
    ((BAND,), (FOUNDATION,), "comps <= 12", "0.04"),
    ((BAND,), (FOUNDATION,), "box > 0.20", "-0.10"),
    ((BAND,), ("scratch_band_clean",), "true", "0.28"),
    ((BAND,), ("structure_tensor_ridge",), "true", "0.24"),
    ((BAND,), ("normal_residual_fusion", "nearest_normal_residual"), "true", "0.10"),
    ((BAND,), ("patchcore_guided",), "true", "0.06"),
    ((BAND,), ("normal_anomaly",), "true", "0.08"),
    ((BAND,), ("multi_linear",), "true", "0.04"),
    ((BAND,), (), "comps > 8", "-0.18"),
    # a single stroke
    ((STROKE,), ("linear", "multi_linear", "structure_tensor_ridge", "normal_anomaly", "nearest_normal_residual", "patchcore_guided", "normal_residual_fusion"), "true", "0.08"),
    # everywhere
    ((), ("procedural",), "true", "-0.30"),
)
#: Values of parameters that are not given, where it is not 0.
PARAMETER_DEFAULTS = {"polar_rim_sector_degrees": 360.0, "repeated_chain_vertical_span_fraction": 1.0}

#: Modes in the order in which they win ties; further ones come last.
HIERARCHY = (
    "normal_anomaly", FOUNDATION, "nearest_normal_residual", "patchcore_guided", "musc_mutual_score", "sam_prompt_regularized", "soft_patch", "scuff_cluster",
    "multi_scuff_fusion", "support_constrained_fusion", "normal_residual_fusion", "repeated_chain_refiner", "polar_rim_residual", "zipper_fabric_border_layout",
    "fft_texture_suppression", "sam2_heatmap", "scratch_band_clean", "structure_tensor_ridge", "residual", "multi_linear", "pixel", "procedural", "ensemble_consensus",
)

#: Where another candidate saves recall: (policy, chosen modes, other, reason, condition). In conditions stand s_ and o_ (area, box, comps, reason_<x>, passes) of
#: both, ratio of areas, height (of the region, as a share) and at_border. Tried in this order.
OVERRIDES = (
    (DIRT, ("fft_texture_suppression",), "bottle_contamination_recall_fusion", "broad_fft_uses_coherent_sam_recall_fusion",
     "s_reason_large_image_area and o_reason_large_image_area and o_reason_large_fraction_of_qwen_box and ratio between 1.25 and 1.85 and o_box <= 0.65 and o_comps <= 12"),
    (CHIP, SAM, "polar_rim_residual", "compact_polar_rim_chip_over_broad_sam", "o_box between 0.020 and 0.045 and s_box >= 0.10 and o_comps <= 3 and o_passes"),
    (TOOTH, ("patchcore_guided",), "zipper_tooth_agreement", "long_tooth_region_patchcore_musc_agreement",
     "height >= 0.65 and ratio between 0.65 and 0.92 and o_passes and o_comps <= s_comps"),
    (TOOTH, ("patchcore_guided",), "ensemble_consensus", "local_tooth_consensus_matches_patchcore_extent",
     "height <= 0.45 and s_comps <= 2 and o_comps <= 2 and ratio between 0.85 and 1.20 and o_passes"),
    (TOOTH, ("patchcore_guided",), "normal_residual_fusion", "edge_split_teeth_preserve_normal_residual_recall",
     "at_border and o_area >= floor(s_area * 1.10) and o_box <= 0.14 and o_reason_touches_image_border"),
    (FABRIC, ("sam2_heatmap",), "ensemble_consensus", "border_touching_sam_prefers_compact_consensus",
     "s_reason_touches_image_border and ratio between 0.65 and 0.92 and o_box <= 0.30 and o_comps <= s_comps"),
)
#: The chain gate: least scale of the region, least span along the axis, least fill, and what is said of each when it fails.
GATE = (("region_already_local", "scale", 0.32), ("baseline_not_chain_spanning", "span", 0.88), ("baseline_sparse_or_multi_local", "fill", 0.25))
GATE_MET, GATE_UNPLACED = "dense_full_chain_overcoverage", "localization_not_valid"


# --- operators -----------------------------------------------------------------------------------------------------


def spoken(*parts: Column, joined: bool = True) -> Column:
    """Lower-case text of category, type and description; ``-`` as ``_`` if ``joined``."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.translate(text, "-", "_") if joined else text


def says(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def structure_profile(category: Column, defect: Column, description: Column) -> Column:
    """Structure the words speak of, or unknown."""
    text, out = spoken(category, defect, description), None
    for name, words, besides in STRUCTURES:
        met = says(text, words) & says(text, besides) if besides else says(text, words)
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise("unknown")


def structure_scale(defect: Column, description: Column) -> Column:
    """micro, small, large or unknown."""
    text, out = spoken(defect, description), None
    for name, words in SCALES:
        out = F.when(says(text, words), name) if out is None else out.when(says(text, words), name)
    return out.otherwise("unknown")


def _sides(region: Column) -> tuple[Column, Column]:
    return region[2] - region[0], region[3] - region[1]


def candidate_of(candidates: Column, mode: str) -> Column:
    """The candidate of a mode, null if there is none."""
    return F.get(F.filter(candidates, lambda c: c["mode"] == mode), F.lit(0))


def scratch_morphology(policy: Column) -> Column:
    """Morphology a policy stands for; not_scratch for those of other defects."""
    known = F.create_map(*[F.lit(x) for kv in MORPHOLOGY.items() for x in kv])
    return F.coalesce(F.try_element_at(known, policy), F.lit("not_scratch"))


def selection_policy(category: Column, defect: Column, description: Column, region: Column, candidates: Column) -> Column:
    """Name of the policy of an image. ``region`` is [x1, y1, x2, y2]."""
    text = spoken(category, defect, description)
    width, height = (F.greatest(F.lit(1), side).cast("double") for side in _sides(region))
    aspect = F.greatest(width / height, height / width)
    hint = says(F.lower(F.coalesce(description, F.lit(""))), AREA_HINTS + MANY_HINTS)
    components = F.coalesce(candidate_of(candidates, "normal_anomaly")["components"], F.lit(0))
    defect = F.coalesce(defect, F.lit(""))
    scratch = F.when((aspect >= 2.2) | ((components >= 3) & ~hint), BAND).when(hint, SCUFF).otherwise(STROKE)
    return (
        F.when(defect == "scratch", scratch)
        .when((category == "bottle") & says(text, FOREIGN_WORDS), DIRT)
        .when((category == "bottle") & (defect == "broken_small"), CHIP)
        .when((category == "bottle") & says(text, CHIP_WORDS), RIM)
        .when((category == "zipper") & defect.isin(*TOOTH_TYPES), TOOTH)
        .when((category == "zipper") & (defect == "fabric_border"), FABRIC)
        .otherwise(SCORE_ONLY)
    )


def chain_gate(status: Column, scale: Column, span: Column, fill: Column) -> Column:
    """struct<enabled, reason>: whether a dense mask along the whole chain must be corrected."""
    values = {"scale": scale, "span": span, "fill": fill}
    reason = F.when(F.coalesce(status, F.lit("")) != "valid", GATE_UNPLACED)
    for name, what, least in GATE:
        reason = reason.when(F.coalesce(values[what], F.lit(0.0)) < least, name)
    reason = reason.otherwise(GATE_MET)
    return F.struct((reason == GATE_MET).alias("enabled"), reason.alias("reason"))


def _filled(text: str, names: dict[str, str], candidates: dict[str, str]) -> str:
    """A condition or change of the tables as SQL: names become their SQL, ``<x>reason_y`` and ``p_y`` look into the candidate of prefix x."""

    def put(m: re.Match) -> str:
        word = m[0]
        if word in names:
            return names[word]
        for prefix, c in candidates.items():
            if word.startswith(f"{prefix}reason_"):
                return f"coalesce(array_contains({c}.reasons, '{word.removeprefix(f'{prefix}reason_')}'), false)"
            if word.startswith(f"{prefix}p_"):
                name = word.removeprefix(f"{prefix}p_")
                return f"coalesce(try_element_at({c}.parameters, '{name}'), {PARAMETER_DEFAULTS.get(name, 0.0)}D)"
        return word

    return re.sub(r"[A-Za-z_]\w*", put, re.sub(r"(?<![\w.])(\d+\.\d+)", r"\1D", text))


def _measures(c: str, prefix: str = "") -> dict[str, str]:
    return {f"{prefix}box": f"coalesce({c}.box_fraction, 0D)", f"{prefix}img": f"coalesce({c}.image_fraction, 0D)", f"{prefix}comps": f"coalesce({c}.components, 0)",
            f"{prefix}area": f"greatest(1, coalesce({c}.mask_area, 0))", f"{prefix}passes": f"coalesce({c}.status, 'pass') = 'pass'"}


def _fit(policy: str) -> list[tuple[tuple[str, ...], str, str]]:
    return [(modes, condition, change) for policies, modes, condition, change in RULES if not policies or policy in policies]


def adjusted_candidates(candidates: str, policy: str, region: str, image_size: str, gate: str, foundation_scale: float = 1.0) -> Column:
    """array<struct<mode, adjusted>> of an image: its candidates' scores moved by the policy.

    Arguments name columns: candidates, policy, region [x1, y1, x2, y2], image
    size [width, height] and whether the chain gate is met.
    """
    share = f"(({region}[2] - {region}[0]) * ({region}[3] - {region}[1]) / greatest(1, {image_size}[0] * {image_size}[1]))"
    names = {**_measures("c"), "region": share, "full": f"({share} >= 0.5D)", "gate": gate}
    cases = []
    for name in ENSEMBLE_BONUS:
        deltas = {m: round(d * foundation_scale, 4) if m == FOUNDATION else d for m, d in MODE_DELTAS.get(name, {}).items()}
        parts = [f"CASE c.mode {' '.join(f"WHEN '{m}' THEN {d}D" for m, d in deltas.items())} ELSE 0D END"] if deltas else ["0D"]
        for modes, condition, change in _fit(name):
            among = f"c.mode IN ({', '.join(f"'{m}'" for m in modes)}) AND " if modes else ""
            parts.append(f"CASE WHEN {among}({_filled(condition, names, {'': 'c'})}) THEN {_filled(change, names, {'': 'c'})} ELSE 0D END")
        cases.append(f"WHEN '{name}' THEN {' + '.join(parts)}")
    linear = f"coalesce(get(filter({candidates}, l -> l.mode = 'linear'), 0).box_fraction, 0D)"
    refused = f"({policy} = '{SCUFF}' AND c.mode = 'linear' AND {linear} < 0.08D)"
    moved = f"bround(greatest(-1D, least(1.5D, coalesce(c.score, -1D) + CASE {policy} {' '.join(cases)} ELSE 0D END)), 4)"
    return F.expr(f"transform({candidates}, c -> struct(c.mode AS mode, CASE WHEN {refused} THEN -1D ELSE {moved} END AS adjusted))")


def with_ensemble(adjusted: Column, policy: Column) -> Column:
    """``adjusted`` with the consensus as the policy has it: by itself plus its bonus, or the best of the others plus it."""
    bonus = F.create_map(*[F.lit(x) for kv in ENSEMBLE_BONUS.items() for x in kv])[policy]
    others = F.filter(adjusted, lambda c: c["mode"] != "ensemble_consensus")
    best = F.array_max(F.transform(others, lambda c: c["adjusted"]))
    clipped = lambda x: F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.5), x)), 4)
    own = lambda c: F.when(policy.isin(*SCORED_BY_ITSELF), clipped(c["adjusted"] + bonus)).otherwise(F.coalesce(best + bonus, c["adjusted"]))
    return F.transform(adjusted, lambda c: F.struct(c["mode"].alias("mode"), F.when(c["mode"] == "ensemble_consensus", own(c)).otherwise(c["adjusted"]).alias("adjusted")))


def best_mode(adjusted: Column) -> Column:
    """Mode of the highest adjusted score; of equal ones the earlier in the hierarchy, then by name."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate(HIERARCHY) for x in (m, -i)])
    key = lambda c: F.struct(c["adjusted"].alias("a"), F.coalesce(F.try_element_at(order, c["mode"]), F.lit(-len(HIERARCHY))).alias("h"), c["mode"].alias("mode"))
    return F.array_max(F.transform(adjusted, key))["mode"]


def arbitrated(candidates: str, chosen: str, policy: str, region: str, image_size: str, gate: str, gate_reason: str) -> Column:
    """struct<mode, reason, applied>: the chosen candidate of an image, or another that the chain gate or an override puts in its place.

    ``candidates`` are the valid ones; arguments name columns.
    """
    one = lambda mode: f"get(filter({candidates}, k -> k.mode = {mode}), 0)"
    height = f"(({region}[3] - {region}[1]) / CAST(greatest(1, {image_size}[1]) AS DOUBLE))"
    fixed = {"height": height, "at_border": f"({region}[1] <= 0 OR {region}[3] >= greatest(1, {image_size}[1]))", "ratio": "(greatest(1, coalesce(b.o.mask_area, 0)) / greatest(1, coalesce(b.s.mask_area, 0)))"}
    tests = []
    for name, modes, other, reason, condition in OVERRIDES:
        both = f"struct({one(chosen)} AS s, {one(f"'{other}'")} AS o)"
        filled = _filled(condition, {**_measures("b.s", "s_"), **_measures("b.o", "o_"), **fixed}, {"s_": "b.s", "o_": "b.o"})
        met = f"transform(array({both}), b -> b.o IS NOT NULL AND ({filled}))[0]"
        among = ", ".join(f"'{m}'" for m in modes)
        tests.append(f"WHEN {policy} = '{name}' AND {chosen} IN ({among}) AND coalesce({met}, false) THEN struct('{other}' AS mode, '{reason}' AS reason, true AS applied)")
    chain = f"WHEN {policy} = '{TOOTH}' AND {gate} AND {one("'repeated_chain_refiner'")} IS NOT NULL THEN struct('repeated_chain_refiner' AS mode, {gate_reason} AS reason, true AS applied)"
    stay = f"struct({chosen} AS mode, 'score_selection' AS reason, false AS applied)"
    return F.expr(f"CASE WHEN {chosen} IS NULL THEN NULL {chain} {' '.join(tests)} ELSE {stay} END")


def localisation_policy(category: Column, defect: Column, description: Column, repeated: Column, rim: Column, sane: Column, least_repeated: float = 0.20, least_rim: float = 1.15) -> Column:
    """How an image's region is found, from words, repeated texture, rim geometry and whether the given box makes sense."""
    text = spoken(category, defect, description, joined=False)
    repeated, rim = F.coalesce(repeated, F.lit(0.0)), F.coalesce(rim, F.lit(0.0))
    tooth = F.coalesce(defect, F.lit("")).isin(*TOOTH_TYPES) | says(text, TOOTH_HINTS)
    chain = says(text, ("zipper", "teeth")) | (says(text, ("tooth", "interlock")) & (repeated >= least_repeated))
    bottle = says(text, ("bottle",)) | (rim >= least_rim)
    return (
        F.when(says(text, FABRIC_HINTS) & ~tooth, "qwen_bbox")
        .when(chain, F.when(tooth, "normal_guided_qwen_verify").otherwise("qwen_bbox"))
        .when(bottle & says(text, FOREIGN_WORDS), "bottle_surface_guided")
        .when(bottle & says(text, CHIP_WORDS), "bottle_rim_guided_qwen")
        .when(~F.coalesce(sane, F.lit(False)) & (repeated >= least_repeated), "normal_guided_qwen_verify")
        .otherwise("qwen_bbox")
    )


def box_is_sane(status: Column, region: Column, width: int, height: int) -> Column:
    """Whether a located box is valid, neither tiny nor nearly everything, and no sliver."""
    w, h = (F.greatest(F.lit(1), side).cast("double") for side in _sides(region))
    share = F.greatest(F.lit(0), region[2] - region[0]) * F.greatest(F.lit(0), region[3] - region[1]) / (width * height)
    return (F.coalesce(status, F.lit("")) == "valid") & share.between(0.0001, 0.72) & (F.greatest(w / h, h / w) <= 25)


def validated_region(box: Column, width: int, height: int, least: float = 0.001, most: float = 0.5, fallback: str = "full_image", inset: float = 0.04) -> Column:
    """struct<region, status, reason>: the box rounded and clipped to the image, or the fallback region and why.

    ``fallback``: full_image or center_inset.
    """
    at = lambda i, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.bround(box[i].cast("double"), 0).cast("int")))
    region = F.array(at(0, 0, width - 1), at(1, 0, height - 1), at(2, 1, width), at(3, 1, height))
    part = (region[2] - region[0]) * (region[3] - region[1]) / (width * height)
    reason = (
        F.when(box.isNull() | (F.size(box) != 4) | F.exists(box, lambda x: x.isNull()), "no_box")
        .when((region[2] <= region[0]) | (region[3] <= region[1]), "empty_after_clipping")
        .when(part < least, "area_below_minimum")
        .when(part > most, "area_above_maximum")
    )
    dx, dy = (round(side * max(0.0, min(0.45, inset))) for side in (width, height))
    other = {"full_image": (0, 0, width, height), "center_inset": (dx, dy, width - dx, height - dy)}[fallback]
    return F.struct(
        F.when(reason.isNull(), region).otherwise(F.array(*[F.lit(x) for x in other])).alias("region"),
        F.when(reason.isNull(), "valid").otherwise("fallback").alias("status"), reason.alias("reason"),
    )


#: Names under which a model's answer gives the box, and the boxes inside it. Fixed values.
BOX_KEYS = ("bbox_xyxy", "bbox", "box", "region")
SUB_BOX_KEYS = ("sub_boxes_xyxy", "boxes_xyxy", "defect_boxes_xyxy", "sub_regions")


def _scaled(values: Column, width: int, height: int) -> Column:
    """Corners in cells: fractions and thousandths of the image are scaled, then rounded."""
    top = F.array_max(values)
    by = lambda unit: F.array(values[0] / unit * width, values[1] / unit * height, values[2] / unit * width, values[3] / unit * height)
    thousandths = (top <= 1000) & ((values[2] > width * 1.2) | (values[3] > height * 1.2))
    scaled = F.when(top <= 1, by(1.0)).when(thousandths, by(1000.0)).otherwise(values)
    return F.transform(scaled, lambda v: F.bround(v, 0).cast("int"))


def parsed_answer(text: Column, width: int, height: int) -> Column:
    """struct<bbox_xyxy, sub_boxes_xyxy, defect_type, confidence, evidence, recovered> of a model's answer, null if it has no box.

    The outermost braces are read as JSON; where that fails, as in an answer cut
    short, the members are picked out of the text.
    """
    body = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    whole = F.when(F.try_parse_json(body).isNotNull(), body)
    member = lambda k: F.get_json_object(whole, f"$.{k}")
    corners = lambda v: F.from_json(v, "array<double>")
    full = lambda b: b.isNotNull() & (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull())
    given = F.coalesce(*[F.nullif(member(k), F.lit("[]")) for k in BOX_KEYS])
    inner = F.coalesce(*[F.nullif(member(k), F.lit("[]")) for k in SUB_BOX_KEYS])
    inner = F.filter(F.from_json(inner, "array<array<double>>"), full)
    box = F.when(full(corners(given)), corners(given))
    found = F.regexp_extract(text, r'"?bbox_xyxy"?\s*:\s*\[([^\]]+)\]', 1)
    numbers = F.transform(F.regexp_extract_all(found, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda v: v.cast("double"))
    picked = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    number = lambda v: v.try_cast("double")
    read = F.struct(
        _scaled(box, width, height).alias("bbox_xyxy"), F.coalesce(F.transform(inner, lambda b: _scaled(b, width, height)), F.array().cast("array<array<int>>")).alias("sub_boxes_xyxy"),
        member("defect_type").alias("defect_type"), number(member("confidence")).alias("confidence"), member("evidence").alias("evidence"), F.lit(False).alias("recovered"),
    )
    recovered = F.struct(
        _scaled(numbers, width, height).alias("bbox_xyxy"), F.array().cast("array<array<int>>").alias("sub_boxes_xyxy"), picked(r'"?defect_type"?\s*:\s*"([^"]*)"').alias("defect_type"),
        number(picked(r'"?confidence"?\s*:\s*(-?\d+(?:\.\d+)?)')).alias("confidence"), picked(r'"?evidence"?\s*:\s*"([^"]*)').alias("evidence"), F.lit(True).alias("recovered"),
    )
    return F.when(whole.isNotNull(), F.when(box.isNotNull(), read)).when(F.size(numbers) == 4, recovered)


# --- generated candidates ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SelectorSettings:
    """Bounds and weights by which generated candidates are refused and scored; None switches a bound off."""

    quality_filter: bool = False
    reject_quality_flags: bool = True
    min_visibility: float = 0.015
    max_background: float = 0.05
    max_outside: float = 0.25
    max_inpaint: float = 0.20
    critic: bool = True
    reject_missing_critic: bool = True
    min_coverage: float = 0.35
    min_fraction: float | None = None
    max_fraction: float | None = None
    min_critic: float | None = None
    preferred: tuple[tuple[str, tuple[str, ...]], ...] = ()
    reject_nonpreferred: bool = False
    preferred_bonus: float = 0.04
    nonpreferred_penalty: float = 0.03
    visibility_weight: float = 1.5
    background_weight: float = 1.0
    outside_weight: float = 0.20
    inpaint_weight: float = 0.05
    flag_penalty: float = 0.05
    critic_weight: float = 0.35
    balance_weight: float = 0.0
    target_fraction: float = 0.38
    fraction_tolerance: float = 0.22
    repaired_penalty: float = 0.0


@dataclass(frozen=True)
class Candidate:
    """Columns of a generated candidate."""

    quality: Column
    visibility: Column
    background: Column
    outside: Column
    inpaint: Column
    flags: Column  # how many
    morphology: Column
    profile: Column
    critic: Column  # the struct, null if there is none
    repaired: Column


def passes_quality(c: Candidate, s: SelectorSettings) -> Column:
    """Whether a candidate passes the filter of training samples."""
    return (c.flags == 0) & (c.visibility >= s.min_visibility) & (c.background <= s.max_background) & (c.outside <= s.max_outside)


def _critic(c: Candidate, name: str) -> Column:
    return safe_number(c.critic[name])


def _preference(c: Candidate, s: SelectorSettings) -> tuple[Column, Column]:
    """(some profile is preferred for the morphology, this one is)."""
    some, own = F.lit(False), F.lit(False)
    for morphology, profiles in s.preferred:
        some = some | (c.morphology == morphology)
        own = own | ((c.morphology == morphology) & c.profile.isin(*profiles))
    return F.coalesce(some, F.lit(False)), F.coalesce(own, F.lit(False))


def refusals(c: Candidate, s: SelectorSettings) -> Column:
    """Why a candidate is refused, in fixed order; none if it is accepted."""
    has, off = c.critic.isNotNull() & F.lit(s.critic), F.lit(False)
    bound = lambda limit, test: test(limit) if limit is not None else off
    some, own = _preference(c, s)
    return reasons(
        ("quality_filtered_training_failed", ~passes_quality(c, s) if s.quality_filter else off),
        ("quality_flags", (c.flags > 0) & F.lit(s.reject_quality_flags)),
        ("low_defect_visibility", c.visibility < s.min_visibility),
        ("high_background_change", c.background > s.max_background),
        ("high_outside_refined_change", c.outside > s.max_outside),
        ("overbroad_inpaint_mask", c.inpaint > s.max_inpaint),
        ("missing_tfidg_lite_metrics", c.critic.isNull() & F.lit(s.critic and s.reject_missing_critic)),
        ("low_tfidg_mask_coverage", has & (_critic(c, "adaptive_mask_coverage_score") < s.min_coverage)),
        ("low_tfidg_mask_coverage_fraction", bound(s.min_fraction, lambda x: has & (_critic(c, "adaptive_mask_coverage_fraction") < x))),
        ("high_tfidg_mask_coverage_fraction", bound(s.max_fraction, lambda x: has & (_critic(c, "adaptive_mask_coverage_fraction") > x))),
        ("low_tfidg_lite_score", bound(s.min_critic, lambda x: has & (_critic(c, "tfidg_lite_score") < x))),
        ("nonpreferred_morphology_profile", some & ~own & F.lit(s.reject_nonpreferred)),
    )


def selector_score(c: Candidate, s: SelectorSettings) -> Column:
    """Score by which candidates compete for a place."""
    some, own = _preference(c, s)
    bonus = F.when(own, s.preferred_bonus).when(some, -s.nonpreferred_penalty).otherwise(0.0)
    apart = F.least(F.lit(1.0), F.abs(_critic(c, "adaptive_mask_coverage_fraction") - s.target_fraction) / max(1e-6, s.fraction_tolerance))
    critic = F.when(c.critic.isNotNull() & F.lit(s.critic), s.critic_weight * _critic(c, "tfidg_lite_score") - s.balance_weight * apart).otherwise(0.0)
    repair = F.when(c.repaired, s.repaired_penalty).otherwise(0.0)
    return (
        c.quality + s.visibility_weight * c.visibility - s.background_weight * c.background - s.outside_weight * c.outside - s.inpaint_weight * c.inpaint
        - s.flag_penalty * c.flags + bonus + critic - repair
    )
