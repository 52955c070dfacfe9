"""Queries that join, deduplicate, sample, score and select records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.functions.paths import file_name, file_stem, file_suffix, parent_dir
from tesserae.operators import relational as R
from tesserae.operators import selection as sel
from tesserae.operators.policy import Candidate, SelectorSettings, refusals, selector_score
from tesserae.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def sql_finite(x: str, default: str = "0") -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN {default} ELSE {x} + 0.0e0 END)"


_V, _L, _O, _I = (sql_finite(c) for c in ("defect_visibility_score", "background_preservation_l1", "outside_refined_change_fraction", "inpaint_mask_area_fraction"))
_C, _F = sql_finite("tfidg_lite.adaptive_mask_coverage_score"), sql_finite("tfidg_lite.adaptive_mask_coverage_fraction")
_Q = f"({_V} - 2*{_L} - 0.1e0*greatest(0.0e0, {_O} - 0.05e0) - 0.05e0*nf)"
#: The selection's bounds and weights; what is not named here has its default.
SETTINGS = SelectorSettings(min_fraction=0.05, max_fraction=0.58, min_critic=0.2, balance_weight=0.12, fraction_tolerance=0.20, repaired_penalty=0.02,
                            preferred=(("thin_linear", ("quality_max",)), ("edge_band", ("standard", "quality_max"))))
_SCORED = f"""
one AS (SELECT * FROM phase4_records QUALIFY row_number() OVER (PARTITION BY phase4_id ORDER BY ingested_at) = 1),
flagged AS (SELECT *, coalesce(len(quality_flags), 0) AS nf, coalesce(settings.quality_morphology, quality_profile, 'unknown') AS morphology, coalesce(quality_profile, 'unknown') AS profile,
  coalesce(critic_guided_generation.selected_repair_index, -1) >= 0 AS repaired FROM one),
scored AS (SELECT *, round({_Q}, 6) + 0.0e0 AS quality,
  round({_Q} + 1.5e0*{_V} - {_L} - 0.2e0*{_O} - 0.05e0*{_I} - 0.05e0*nf
    + CASE morphology WHEN 'thin_linear' THEN CASE WHEN profile = 'quality_max' THEN 0.04e0 ELSE -0.03e0 END WHEN 'edge_band' THEN CASE WHEN profile IN ('standard', 'quality_max') THEN 0.04e0 ELSE -0.03e0 END ELSE 0.0e0 END
    + CASE WHEN tfidg_lite IS NULL THEN 0.0e0 ELSE 0.35e0*{sql_finite('tfidg_lite.tfidg_lite_score')} - 0.12e0*least(1.0e0, abs({_F} - 0.38e0) / 0.2e0) END
    - CASE WHEN repaired THEN 0.02e0 ELSE 0.0e0 END, 6) + 0.0e0 AS score,
  list_filter([
    CASE WHEN nf > 0 THEN 'quality_flags' END,
    CASE WHEN {_V} < 0.015 THEN 'low_defect_visibility' END,
    CASE WHEN {_L} > 0.05 THEN 'high_background_change' END,
    CASE WHEN {_O} > 0.25 THEN 'high_outside_refined_change' END,
    CASE WHEN {_I} > 0.2 THEN 'overbroad_inpaint_mask' END,
    CASE WHEN tfidg_lite IS NULL THEN 'missing_tfidg_lite_metrics' END,
    CASE WHEN tfidg_lite IS NOT NULL AND {_C} < 0.35 THEN 'low_tfidg_mask_coverage' END,
    CASE WHEN tfidg_lite IS NOT NULL AND {_F} < 0.05 THEN 'low_tfidg_mask_coverage_fraction' END,
    CASE WHEN tfidg_lite IS NOT NULL AND {_F} > 0.58 THEN 'high_tfidg_mask_coverage_fraction' END,
    CASE WHEN tfidg_lite IS NOT NULL AND {sql_finite('tfidg_lite.tfidg_lite_score')} < 0.2 THEN 'low_tfidg_lite_score' END
  ], lambda x: x IS NOT NULL) AS reasons FROM flagged)
"""


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-4 candidates, as often as delivered, with quality, score and reasons against them."""
    fields = ["category", "defect_type", "provider", "variant", "quality_profile", "defect_visibility_score", "background_preservation_l1",
              "outside_refined_change_fraction", "inpaint_mask_area_fraction", "quality_flags", "settings", "tfidg_lite", "critic_guided_generation"]
    rows = table(spark, sf_dir, "phase4_records").filter("phase4_id is not null").select("phase4_id", *fields)
    v, l1, out, inp = (S.safe_number(F.col(c)) for c in fields[5:9])
    flags = F.greatest(F.coalesce(F.size("quality_flags"), F.lit(0)), F.lit(0))
    quality = sel.quality_score(v, l1, out, flags)
    morphology = F.coalesce("settings.quality_morphology", "quality_profile", F.lit("unknown"))
    repaired = F.coalesce(F.col("critic_guided_generation.selected_repair_index"), F.lit(-1)) >= 0
    c = Candidate(quality, v, l1, out, inp, flags, morphology, F.coalesce("quality_profile", F.lit("unknown")), F.col("tfidg_lite"), repaired)
    rows = rows.withColumn("repaired", repaired).withColumn("quality", F.round(quality, 6) + 0.0)
    return rows.withColumn("score", F.round(selector_score(c, SETTINGS), 6) + 0.0).withColumn("reasons", refusals(c, SETTINGS))


def measured_candidates(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """(phase4_id, columns...) once per candidate.

    What is asked for is computed row by row first; deliveries of one record
    have equal values, so only the few results are shuffled to make them one.
    """
    return scored_candidates(spark, sf_dir).select("phase4_id", *columns).dropDuplicates(["phase4_id"])


@query(f"WITH {_SCORED} SELECT phase4_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM scored")
def reject_reasons(spark, sf_dir):
    """Why each candidate is refused."""
    return measured_candidates(spark, sf_dir, F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("accepted"))


@query(f"WITH {_SCORED} SELECT phase4_id, quality, score FROM scored")
def quality_score(spark, sf_dir):
    """Quality and selector score of each candidate."""
    return measured_candidates(spark, sf_dir, "quality", "score")


_CAPPED = """
kinds AS (SELECT phase4_id, category, defect_type, score, repaired AS special FROM scored
  WHERE len(reasons) = 0 AND category IS NOT NULL AND defect_type IS NOT NULL),
nth AS (SELECT *, row_number() OVER (PARTITION BY category, defect_type, special ORDER BY score DESC, phase4_id) AS n FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY category, defect_type ORDER BY (special AND n > 5)::INT, score DESC, phase4_id)::INT AS place FROM nth)
"""


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_candidates(spark, sf_dir).filter("size(reasons) = 0 and category is not null and defect_type is not null")
    return sel.capped_top_k(rows, ["category", "defect_type"], "score", "phase4_id", F.col("repaired"), 10, 0.5, repeated=True)


@query(f"WITH {_SCORED}, {_CAPPED} SELECT category, defect_type, place, phase4_id, score, special AS repaired FROM placed WHERE place <= 10")
def capped_topk_select(spark, sf_dir):
    """Ten best accepted candidates per group, at most half of them repaired while others are left."""
    return _capped(spark, sf_dir).select("category", "defect_type", "place", "phase4_id", "score", F.col("special").alias("repaired"))


@query(
    f"""WITH {_SCORED}, {_CAPPED}, log AS (
  SELECT s.phase4_id, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ',') WHEN p.phase4_id IS NULL THEN 'selector_group_limit' ELSE '' END AS why
  FROM scored s LEFT JOIN (SELECT phase4_id FROM placed WHERE place <= 10) p USING (phase4_id) WHERE category IS NOT NULL AND defect_type IS NOT NULL)
SELECT phase4_id, why, why = '' AS accepted FROM log"""
)
def selector_log(spark, sf_dir):
    """Both outcomes of the selection, with the reason."""
    named = F.col("category").isNotNull() & F.col("defect_type").isNotNull()
    rows = measured_candidates(spark, sf_dir, F.array_join("reasons", ",").alias("reasons"), named.alias("named")).filter("named")
    chosen = _capped(spark, sf_dir).select("phase4_id", F.lit(True).alias("in"))
    why = F.when(F.col("reasons") != "", F.col("reasons")).when(F.col("in").isNull(), "selector_group_limit").otherwise("")
    return rows.join(chosen, "phase4_id", "left").select("phase4_id", why.alias("why"), (why == "").alias("accepted"))


@query(f"WITH {_SCORED} SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM scored) GROUP BY reason")
def selector_summary(spark, sf_dir):
    """How often each reason stands."""
    rows = measured_candidates(spark, sf_dir, F.array_join("reasons", ",").alias("reasons"))
    return sel.reason_histogram(rows.filter("reasons <> ''").withColumn("reasons", F.split("reasons", ",")), "reasons")


@query(
    f"""WITH {_SCORED} SELECT settings.quality_morphology AS morphology, quality_profile, count(*) AS n_rows,
  count(*) FILTER (len(reasons) = 0) AS accepted, round(avg(score), 9) AS mean_score FROM scored GROUP BY ALL"""
)
def accepted_by_profile(spark, sf_dir):
    """Accepted rows and mean score per morphology and profile."""
    morphology, fine = F.col("settings.quality_morphology").alias("morphology"), (F.size("reasons") == 0).alias("fine")
    rows = measured_candidates(spark, sf_dir, morphology, "quality_profile", "score", fine)
    return rows.groupBy("morphology", "quality_profile").agg(
        F.count("*").alias("n_rows"), F.count_if("fine").alias("accepted"), F.round(F.avg("score"), 9).alias("mean_score")
    )


@query(
    f"""WITH {_SCORED} SELECT category, defect_type, GROUPING(category)::INT AS all_categories, GROUPING(defect_type)::INT AS all_types,
  count(*) AS n_rows, round(avg(score), 9) AS mean_score FROM scored GROUP BY ROLLUP (category, defect_type)"""
)
def rollup_report(spark, sf_dir):
    """Counts and mean scores with their subtotals in one pass."""
    return measured_candidates(spark, sf_dir, "category", "defect_type", "score").rollup("category", "defect_type").agg(
        F.grouping("category").cast("int").alias("all_categories"), F.grouping("defect_type").cast("int").alias("all_types"),
        F.count("*").alias("n_rows"), F.round(F.avg("score"), 9).alias("mean_score"),
    )


# --- predictions, arbitration --------------------------------------------------------------------------------------

_HEUR = """
lite AS (SELECT phase4_id, {c} AS c, {a} AS a, {d} AS d, {s} AS s FROM one WHERE tfidg_lite IS NOT NULL),
pred AS (SELECT phase4_id, least(1.0e0, greatest(0.0e0, 0.10e0 + 0.48e0*c + 0.30e0*a - 0.32e0*d - 0.25e0*greatest(0.0e0, s - 0.20e0))) AS iou, d FROM lite)
""".format(
    c=sql_finite("tfidg_lite.adaptive_mask_coverage_score"), a=sql_finite("tfidg_lite.feature_alignment_score"), d=f"(1 - {sql_finite('tfidg_lite.leakage_score')})",
    s=sql_finite("tfidg_lite.adaptive_mask_coverage_fraction"),
)


@query(
    f"""WITH one AS (SELECT * FROM phase4_records QUALIFY row_number() OVER (PARTITION BY phase4_id ORDER BY ingested_at) = 1), {_HEUR},
r AS (SELECT phase4_id, round(iou, 6) AS iou, round(greatest(0.0e0, iou - 0.18e0), 6) AS lower_bound, round(d, 6) AS disagreement FROM pred)
SELECT phase4_id, iou, lower_bound, CASE WHEN lower_bound >= 0.45 AND disagreement <= 0.2 THEN 'hard_mask_ok' WHEN iou >= 0.25 THEN 'soft_mask_only' ELSE 'needs_review' END AS disposition FROM r"""
)
def disposition(spark, sf_dir):
    """Predicted overlap without a model, and what may be done with the mask."""
    rows = R.once(table(spark, sf_dir, "phase4_records"), "phase4_id", "tfidg_lite").filter("tfidg_lite is not null")
    lite = lambda f: S.safe_number(F.col(f"tfidg_lite.{f}"))
    wrong = 1 - lite("leakage_score")
    p = sel.heuristic_prediction(lite("adaptive_mask_coverage_score"), lite("feature_alignment_score"), wrong, lite("adaptive_mask_coverage_fraction"))
    rows = rows.select("phase4_id", F.round(p["iou"], 6).alias("iou"), F.round(p["lower_bound"], 6).alias("lower_bound"), F.round(wrong, 6).alias("w"))
    return rows.select("phase4_id", "iou", "lower_bound", sel.disposition(F.col("iou"), F.col("lower_bound"), F.col("w")).alias("disposition"))


@query(
    f"""WITH one AS (SELECT * FROM phase4_records QUALIFY row_number() OVER (PARTITION BY phase4_id ORDER BY ingested_at) = 1),
m AS (SELECT provider, variant, round(avg({_V}), 6) AS auroc, round(avg(1 - least(1.0e0, {_L})), 6) AS aupro, round(avg({sql_finite('generation_quality_score')}), 6) AS dice,
  round(avg({_O}), 6) AS rate, round(avg({_I}), 6) AS truth, round(count(*) FILTER (len(quality_flags) > 0) / count(*), 6) AS ratio FROM one WHERE provider IS NOT NULL AND variant IS NOT NULL GROUP BY ALL),
base AS (SELECT provider, auroc AS b_auroc, aupro AS b_aupro, dice AS b_dice FROM m WHERE variant = 'zero_gate'),
g AS (SELECT *, 0.45e0*auroc + 0.55e0*aupro AS ranking, coalesce(dice - b_dice >= 0.005, false) AS dg, coalesce((0.45e0*auroc + 0.55e0*aupro) - (0.45e0*b_auroc + 0.55e0*b_aupro) >= 0.005, false) AS rg,
  rate > 1.5e0*greatest(truth, 1e-6) AS inf FROM m LEFT JOIN base USING (provider))
SELECT provider, variant, round(0.45e0*ranking + 0.55e0*dice, 5) AS utility, CASE WHEN ratio >= 0.5 AND inf AND NOT dg THEN 'demote_ratio' WHEN dg AND rg AND NOT inf THEN 'recommended'
  WHEN dg OR rg THEN 'candidate' WHEN ratio >= 0.5 THEN 'demote_ratio' ELSE 'candidate' END AS verdict FROM g"""
)
def ratio_arbitration(spark, sf_dir):
    """Each provider's variants against its baseline, the variant without gate; a provider without one gains nothing."""
    rows = R.once(table(spark, sf_dir, "phase4_records"), "phase4_id", "provider", "variant", "defect_visibility_score", "background_preservation_l1",
                  "generation_quality_score", "outside_refined_change_fraction", "inpaint_mask_area_fraction", "quality_flags")
    n = lambda c: S.safe_number(F.col(c))
    mean = lambda c: F.round(F.avg(c), 6)
    m = rows.filter("provider is not null and variant is not null").groupBy("provider", "variant").agg(
        mean(n("defect_visibility_score")).alias("auroc"), mean(1 - F.least(F.lit(1.0), n("background_preservation_l1"))).alias("aupro"),
        mean(n("generation_quality_score")).alias("dice"), mean(n("outside_refined_change_fraction")).alias("rate"),
        mean(n("inpaint_mask_area_fraction")).alias("truth"), F.round(F.count_if(F.size("quality_flags") > 0) / F.count("*"), 6).alias("ratio"),
    )
    base = m.filter("variant = 'zero_gate'").select("provider", *[F.col(c).alias(f"b_{c}") for c in ("auroc", "aupro", "dice")])
    both = m.join(base, "provider", "left")
    a = sel.arbitration(F.col("auroc"), F.col("aupro"), F.col("dice"), F.col("rate"), F.col("truth"), F.col("ratio"), {c: F.col(f"b_{c}") for c in ("auroc", "aupro", "dice")})
    return both.select("provider", "variant", F.round(a["utility"], 5).alias("utility"), a["verdict"].alias("verdict"))


# --- joins, dedup, sampling ----------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_wins_index(spark, sf_dir):
    """Of events with one key the last one counts."""
    return R.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def first_wins_dedup(spark, sf_dir):
    """Of events with one key the first one counts."""
    return R.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def strict_lookup(spark, sf_dir):
    """Orders with their customer; one without would fail the query."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.strict_lookup(orders, customers, ["o_custkey"]).drop("o_custkey")


@query(
    """WITH v AS (SELECT doc_id, max(offensive) AS offensive, count(*) AS n FROM review_labels GROUP BY 1)
SELECT d.doc_id, d.source, v.offensive, coalesce(v.n, 0) AS n_reviews FROM documents d LEFT JOIN v USING (doc_id)"""
)
def left_metrics(spark, sf_dir):
    """Documents with what reviewers said, if anything."""
    said = table(spark, sf_dir, "review_labels").groupBy("doc_id").agg(F.max("offensive").alias("offensive"), F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(said, "doc_id", "left").select("doc_id", "source", "offensive", F.coalesce("n", F.lit(0)).alias("n_reviews"))


@query(
    """WITH s AS (SELECT DISTINCT doc_id FROM review_labels)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM s) THEN 'carry' ELSE 'compute' END AS action FROM documents"""
)
def semi_anti_merge(spark, sf_dir):
    """Rerun plan: reviewed documents are carried, the rest is to do."""
    return R.carried_and_missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "review_labels"), ["doc_id"])


@query(
    """WITH a AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS v FROM customer WHERE c_acctbal > 9500 GROUP BY ALL),
b AS (SELECT c_mktsegment, round(avg(c_acctbal), 4) AS v FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL)
SELECT c_custkey, coalesce(a.v, b.v, -1.0e0) AS level FROM customer LEFT JOIN a USING (c_nationkey, c_mktsegment) LEFT JOIN b USING (c_mktsegment)"""
)
def priority_lookup(spark, sf_dir):
    """A value by (nation, segment), else by segment, else a default."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    mean = F.round(F.avg("c_acctbal"), 4).alias("level")
    fine = c.filter("c_acctbal > 9500").groupBy("c_nationkey", "c_mktsegment").agg(mean)
    coarse = c.filter("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(mean)
    levels = [(["c_nationkey", "c_mktsegment"], fine), (["c_mktsegment"], coarse)]
    return R.priority_lookup(c.select("c_custkey", "c_nationkey", "c_mktsegment"), levels, "level", F.lit(-1.0)).select("c_custkey", "level")


@query(
    """WITH r AS (SELECT s_nationkey AS n, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS k FROM supplier)
SELECT c_custkey, s_suppkey FROM customer JOIN r ON n = c_nationkey AND c_custkey % k = i"""
)
def cyclic_reference(spark, sf_dir):
    """Each customer with the supplier of its nation that its number falls on."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"))
    return R.cyclic_pairs(c, s, ["n"], F.col("c_custkey"), "s_suppkey", ["s_suppkey"]).select("c_custkey", "s_suppkey")


@query("SELECT r_name, c_mktsegment, s.seed::INT AS seed FROM region, (SELECT DISTINCT c_mktsegment FROM customer), generate_series(0, 2) s(seed)")
def experiment_matrix(spark, sf_dir):
    """Every combination of region, segment and seed."""
    seeds = spark.range(3).select(F.col("id").cast("int").alias("seed"))
    return R.experiment_matrix(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "customer").select("c_mktsegment").distinct(), seeds)


@query("SELECT event_id, coalesce((props->>'$.k')::INT, -1) AS k, coalesce(nullif(nullif(props->>'$.k', ''), '0'), event_type) AS label FROM events")
def nested_default(spark, sf_dir):
    """A nested value with its default, and the first value that says anything."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", F.coalesce(k.try_cast("int"), F.lit(-1)).alias("k"), S.first_truthy(k, F.col("event_type")).alias("label"))


@query(
    f"""WITH one AS (SELECT * FROM phase4_records QUALIFY row_number() OVER (PARTITION BY phase4_id ORDER BY ingested_at) = 1)
SELECT phase4_id, {_V} AS visibility, {sql_finite('gate_value', '-1')} AS gate FROM one"""
)
def safe_cast(spark, sf_dir):
    """Numbers that are none become their default."""
    rows = R.once(table(spark, sf_dir, "phase4_records"), "phase4_id", "defect_visibility_score", "gate_value")
    return rows.select("phase4_id", S.safe_number(F.col("defect_visibility_score")).alias("visibility"), S.safe_number(F.col("gate_value"), -1.0).alias("gate"))


@query(
    r"""SELECT artifact_id, any_value(regexp_extract(rel_path, '([^/]*)$', 1)) AS name, any_value(regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\.[^.]*$', '')) AS stem,
  any_value(lower(regexp_extract(rel_path, '(\.[^./]*)$', 1))) AS suffix, any_value(regexp_replace(rel_path, '/?[^/]*$', '')) AS dir FROM artifact_inventory GROUP BY 1"""
)
def path_parts(spark, sf_dir):
    """Name, stem, suffix and directory of every file."""
    p = F.col("rel_path")
    files = R.once(table(spark, sf_dir, "artifact_inventory"), "artifact_id", "rel_path")
    return files.select("artifact_id", file_name(p).alias("name"), file_stem(p).alias("stem"), file_suffix(p).alias("suffix"), parent_dir(p).alias("dir"))


@query(
    """WITH f AS (SELECT DISTINCT artifact_id, kind, sha256(concat_ws('|', artifact_id::VARCHAR, coalesce(rel_path, ''), coalesce(content_hash, ''))) AS d FROM artifact_inventory WHERE artifact_id IS NOT NULL)
, p AS (SELECT kind, substr(d, 1, 3) || sha256(string_agg(d, ',' ORDER BY d)) AS h, count(*) AS n FROM f GROUP BY kind, substr(d, 1, 3))
SELECT kind, sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint, sum(n)::BIGINT AS n_rows FROM p GROUP BY kind"""
)
def content_fingerprint(spark, sf_dir):
    """One digest per kind of file, which any change of a file changes."""
    files = R.once(table(spark, sf_dir, "artifact_inventory"), "artifact_id", "kind", "rel_path", "content_hash")
    return R.content_fingerprint(files, ["kind"], "artifact_id", "rel_path", "content_hash")


@query(
    """SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY sha256('7|' || event_type || '|' || event_id), event_id) <= 100 THEN 'adaptation' ELSE 'held_out' END AS split FROM events"""
)
def split_adapt_holdout(spark, sf_dir):
    """A seeded split of each type: 100 rows adapt, the rest is held out."""
    return R.hash_split(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], "event_id", "7", 100)


@query(
    """WITH r AS (SELECT event_id FROM events WHERE event_type <> 'error' AND event_type <> 'click'), s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events WHERE event_type = 'click'),
w AS (SELECT greatest(1, round_even((SELECT count(*) FROM r) * 0.5e0 / (1 - 0.5e0), 0))::BIGINT AS want)
SELECT event_id, 'real' AS kind, 0 AS copy FROM r UNION ALL
SELECT event_id, 'synthetic', (g.c)::INT FROM s, w, generate_series(0, 50) g(c) WHERE g.c * n + i < want"""
)
def ratio_mix(spark, sf_dir):
    """Clicks repeated in turn until they are half of the whole."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    real, synthetic = e.filter("event_type not in ('error', 'click')").drop("event_type"), e.filter("event_type = 'click'").drop("event_type")
    return R.ratio_mix(real, synthetic, "event_id", 0.5)


@query(
    """WITH k AS (SELECT event_type, count(*) AS size, row_number() OVER (ORDER BY event_type) - 1 AS k, count(*) OVER () AS keys FROM events GROUP BY 1),
p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events)
SELECT t.turn, k.event_type, p.event_id FROM generate_series(0, 499) t(turn) JOIN k ON t.turn % k.keys = k.k JOIN p ON p.event_type = k.event_type AND p.pos = t.turn % k.size"""
)
def class_balanced_mix(spark, sf_dir):
    """500 events taken from the types in turn."""
    return R.balanced_round_robin(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], "event_id", 500)


@query(
    """WITH n AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, label FROM n WHERE i IN (SELECT (j * (n.n - 1)) // 49 FROM generate_series(0, 49) g(j))"""
)
def linspace_subsample(spark, sf_dir):
    """50 vectors at even distances."""
    return R.even_subsample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 50)


@query(
    """SELECT generation_id, ('0x' || substr(sha256('"' || coalesce(any_value(category), '') || '"'), 1, 8))::BIGINT AS seed FROM generation_records GROUP BY 1"""
)
def stable_seeds(spark, sf_dir):
    """A number per category that never changes."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "category")
    return rows.select("generation_id", S.stable_seed(F.coalesce("category", F.lit(""))).alias("seed"))


@query(
    """WITH one AS (SELECT generation_id, any_value(settings) AS s FROM generation_records GROUP BY 1),
b AS (SELECT generation_id, s.target_bbox_xyxy AS q FROM one WHERE len(s.target_bbox_xyxy) = 4 AND len(list_filter(s.target_bbox_xyxy, lambda x: x IS NULL)) = 0),
c AS (SELECT generation_id, greatest(0, least(512, least(q[1], q[3]))) AS x1, greatest(0, least(512, least(q[2], q[4]))) AS y1, greatest(0, least(512, greatest(q[1], q[3]))) AS x2, greatest(0, least(512, greatest(q[2], q[4]))) AS y2 FROM b),
m AS (SELECT *, (x2-x1)*(y2-y1) AS area, (x2-x1)::DOUBLE AS w, (y2-y1)::DOUBLE AS h FROM c)
SELECT generation_id, area, CASE WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN w*h/262144 < 0.0001 THEN 'too_small' WHEN w*h/262144 > 0.72 THEN 'too_large' WHEN greatest(w/h, h/w) > 25 THEN 'too_thin' ELSE 'ok' END AS state FROM m"""
)
def box_validation(spark, sf_dir):
    """Target boxes put in order and inside the image, and whether they make sense."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "settings")
    q = F.col("settings.target_bbox_xyxy")
    rows = rows.filter((F.size(q) == 4) & ~F.exists(q, lambda x: x.isNull()))
    rows = rows.select("generation_id", S.clipped_box(S.box(q[0], q[1], q[2], q[3]), F.lit(512), F.lit(512)).alias("b"))
    return rows.select("generation_id", S.box_area(F.col("b")).alias("area"), S.box_state(F.col("b"), F.lit(512), F.lit(512)).alias("state"))
