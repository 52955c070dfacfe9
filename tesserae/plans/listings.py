"""Queries on lookups, filters, quotas, profiles and boxes of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import listings as L
from tesserae.operators import relational as R
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


_ONE = "one AS (SELECT * FROM auto_mask_records WHERE auto_mask_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY auto_mask_id ORDER BY ingested_at) = 1)"
_GEN = "gen AS (SELECT * FROM generation_records WHERE generation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY generation_id ORDER BY ingested_at) = 1)"


def _stem(c: str) -> str:
    return rf"lower(regexp_replace(regexp_extract(replace(trim({c}), '\', '/'), '([^/]*)$', 1), '\.[^.]*$', ''))"


@query(
    f"""WITH {_ONE}, img AS (SELECT {_stem('image_path')} AS stem, min(image_path) AS image FROM one WHERE image_path IS NOT NULL GROUP BY 1)
SELECT auto_mask_id, image FROM (SELECT auto_mask_id, regexp_replace({_stem('mask_path')}, '_mask$', '') AS stem FROM one WHERE mask_path IS NOT NULL) m LEFT JOIN img USING (stem)"""
)
def images_of_masks(spark, sf_dir):
    """The image each mask belongs to, by name; masks without one are kept."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "image_path", "mask_path")
    found = L.images_of_masks(rows.filter("mask_path is not null").select("auto_mask_id", "mask_path"), "mask_path", rows, "image_path", [], strict=False)
    return found.select("auto_mask_id", "image")


@query(
    f"""WITH {_GEN}, f AS (SELECT DISTINCT rel_path AS p FROM artifact_inventory)
SELECT generation_id, CASE WHEN output_path IN (SELECT p FROM f) THEN output_path WHEN source_mask_path IN (SELECT p FROM f) THEN source_mask_path WHEN source_image_path IN (SELECT p FROM f) THEN source_image_path END AS path FROM gen"""
)
def first_existing_path(spark, sf_dir):
    """The first of a record's files, as written, that the inventory knows."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "output_path", "source_mask_path", "source_image_path")
    files = table(spark, sf_dir, "artifact_inventory").select(F.col("rel_path").alias("path"))
    return L.first_existing(rows, ["output_path", "source_mask_path", "source_image_path"], files, "path").select("generation_id", "path")


@query(f"WITH {_GEN} SELECT model, count(*) AS n_rows FROM gen WHERE model IN ('sd15', 'mock') GROUP BY 1")
def optional_filters(spark, sf_dir):
    """Records of two models; no category is asked for, so all count."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "model", "category")
    return L.optional_filters(rows, {"model": ["sd15", "mock"], "category": []}).groupBy("model").agg(F.count("*").alias("n_rows"))


@query(
    f"""WITH {_GEN}, b AS (SELECT generation_id, CASE defect_type WHEN 'crack' THEN 'Crack' WHEN 'glue_strip' THEN 'resin' ELSE coalesce(defect_type, '') END AS label, settings.target_bbox_xyxy AS q FROM gen),
s AS (SELECT generation_id, label, (q[3] - q[1]) / 512.0e0 AS w, (q[4] - q[2]) / 512.0e0 AS h FROM b WHERE len(q) = 4)
SELECT generation_id, coalesce(CASE label WHEN 'Crack' THEN w * h >= 0.003 AND greatest(w, h) >= 0.18 WHEN 'resin' THEN w * h >= 0.0015 AND greatest(w, h) >= 0.06 ELSE w * h >= 0.006 AND greatest(w, h) >= 0.1 END, false) AS useful FROM s"""
)
def useful_boxes(spark, sf_dir):
    """Whether each target box is worth cutting out."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "defect_type", "settings").filter("size(settings.target_bbox_xyxy) = 4")
    q = F.col("settings.target_bbox_xyxy")
    label = F.when(F.col("defect_type") == "crack", "Crack").when(F.col("defect_type") == "glue_strip", "resin").otherwise(F.coalesce("defect_type", F.lit("")))
    return rows.select("generation_id", L.useful_box(label, (q[2] - q[0]) / 512.0, (q[3] - q[1]) / 512.0).alias("useful"))


@query(
    f"""WITH {_ONE} SELECT auto_mask_id, 'evaluation' AS policy, eval_mask_path AS path FROM one UNION ALL SELECT auto_mask_id, 'refined', refined_mask_path FROM one UNION ALL SELECT auto_mask_id, 'uncertainty', uncertainty_mask_path FROM one"""
)
def rows_per_policy(spark, sf_dir):
    """A row per image and mask policy."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "eval_mask_path", "refined_mask_path", "uncertainty_mask_path")
    return L.per_policy(rows, {"evaluation": "eval_mask_path", "refined": "refined_mask_path", "uncertainty": "uncertainty_mask_path"}, "policy", "path")


@query(
    f"""WITH {_GEN} SELECT model, error IS NOT NULL AS failed, round(coalesce(avg(CASE WHEN isnan(latency_sec) OR isinf(latency_sec) THEN NULL ELSE latency_sec END), 0), 6) AS mean_latency FROM gen GROUP BY ALL"""
)
def mean_or_zero(spark, sf_dir):
    """Mean latency per model and outcome, 0 where nothing was measured."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "model", "error", "latency_sec")
    x = F.when(~F.isnan("latency_sec") & (F.abs("latency_sec") != float("inf")), F.col("latency_sec"))
    return rows.groupBy("model", F.col("error").isNotNull().alias("failed")).agg(F.round(L.mean_or_zero(x), 6).alias("mean_latency"))


@query(
    f"WITH {_ONE} SELECT (row_number() OVER (ORDER BY category NULLS FIRST, defect_type NULLS FIRST, auto_mask_id))::INT AS place, auto_mask_id FROM one ORDER BY place LIMIT 50"
)
def sorted_row_cap(spark, sf_dir):
    """The first fifty records by category, type and id: the rows a trial run is asked to work on."""
    from pyspark.sql import Window

    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "category", "defect_type").orderBy("category", "defect_type", "auto_mask_id").limit(50)
    return rows.select(F.row_number().over(Window.orderBy("category", "defect_type", "auto_mask_id")).alias("place"), "auto_mask_id")


@query(f"WITH {_GEN} SELECT generation_id FROM gen ORDER BY sha256('jobs|' || generation_id), generation_id LIMIT 40")
def capped_jobs(spark, sf_dir):
    """Forty records in a seeded order."""
    rows = table(spark, sf_dir, "generation_records").select("generation_id").filter("generation_id is not null").distinct()
    return L.capped_jobs(rows, "generation_id", "jobs", 40)


@query(
    f"""WITH {_GEN}, r AS (SELECT model, generation_id, row_number() OVER (PARTITION BY model ORDER BY sha256('fill|' || generation_id), generation_id) AS nth FROM gen)
SELECT model, generation_id, nth::INT AS nth FROM r WHERE (model = 'sd15' AND nth <= 12) OR (model = 'mock' AND nth <= 5)"""
)
def quota_fill(spark, sf_dir):
    """Twelve records of one model and five of another."""
    rows = table(spark, sf_dir, "generation_records").select("generation_id", "model").filter("generation_id is not null").distinct()
    return L.quota_fill(rows, "model", "generation_id", {"sd15": 12, "mock": 5}, "fill").select("model", "generation_id", "nth")


@query(
    f"""WITH {_ONE}, {_GEN}, d AS (SELECT key, max(t) AS t FROM (SELECT category || '/' || defect_type AS key, settings.prompt AS t FROM gen UNION ALL SELECT category, settings.prompt FROM gen) WHERE key IS NOT NULL AND t <> '' GROUP BY 1)
SELECT auto_mask_id, coalesce(nullif(description, ''), a.t, b.t, 'a visible ' || coalesce(defect_type, 'defect')) AS text FROM one LEFT JOIN d a ON a.key = category || '/' || defect_type LEFT JOIN d b ON b.key = category"""
)
def described_images(spark, sf_dir):
    """A description for every image: its own, its target's, its category's, or a plain one."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "category", "defect_type", "description")
    gen = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "category", "defect_type", "settings")
    target = F.concat("category", F.lit("/"), "defect_type")
    known = gen.select(target.alias("key"), F.col("settings.prompt").alias("text")).unionByName(gen.select(F.col("category").alias("key"), F.col("settings.prompt").alias("text")))
    plain = F.concat(F.lit("a visible "), F.coalesce("defect_type", F.lit("defect")))
    found = L.described(rows, known, [target, F.col("category")], plain, "other")
    return found.select("auto_mask_id", F.coalesce(F.when(F.col("description") != "", F.col("description")), "other").alias("text"))


@query(
    f"""WITH {_ONE}, m AS (SELECT auto_mask_id, coalesce(CASE WHEN settings.label_policy.quality_morphology IN ('multi_scuff', 'single_stroke', 'scratch_band', 'crack_band') THEN settings.label_policy.quality_morphology END,
  CASE WHEN regexp_matches(lower(coalesce(description, '')), 'scuff|many|multiple|rubbed') THEN 'multi_scuff' WHEN regexp_matches(lower(coalesce(description, '')), 'single|one long|one narrow') THEN 'single_stroke' WHEN lower(defect_type) = 'crack' THEN 'crack_band' ELSE 'scratch_band' END) AS morphology FROM one)
SELECT auto_mask_id, morphology, CASE morphology WHEN 'multi_scuff' THEN ['scuff_soft_low_strength'] WHEN 'single_stroke' THEN ['scratch_thin_detail'] ELSE ['scratch_ridge_balanced', 'scratch_thin_detail'] END AS profiles FROM m"""
)
def profile_routes(spark, sf_dir):
    """Profiles of generation that suit each image's morphology, out of two that are asked for."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "defect_type", "description", "settings")
    given = F.col("settings.label_policy.quality_morphology")
    given = F.when(given.isin("multi_scuff", "single_stroke", "scratch_band", "crack_band"), given)
    rows = rows.select("auto_mask_id", L.morphology([given], F.col("description"), F.col("defect_type")).alias("morphology"))
    return rows.withColumn("profiles", L.profiles_for(F.col("morphology"), ["scratch_ridge_balanced", "scratch_thin_detail"]))


@query(
    f"""WITH {_ONE}, b AS (SELECT auto_mask_id, list_filter(settings.qwen_sub_boxes_xyxy, lambda b: b IS NOT NULL AND len(b) = 4 AND len(list_filter(b, lambda v: v IS NULL)) = 0) AS bs FROM one),
u AS (SELECT auto_mask_id, list_min(list_transform(bs, lambda b: b[1])) AS x1, list_min(list_transform(bs, lambda b: b[2])) AS y1, list_max(list_transform(bs, lambda b: b[3])) AS x2, list_max(list_transform(bs, lambda b: b[4])) AS y2 FROM b WHERE len(bs) > 0),
p AS (SELECT *, round_even((x2 - x1) * 0.1e0, 0)::INT AS px, round_even((y2 - y1) * 0.1e0, 0)::INT AS py FROM u),
c AS (SELECT auto_mask_id, greatest(0, x1 - px) AS x1, greatest(0, y1 - py) AS y1, least(512, x2 + px) AS x2, least(512, y2 + py) AS y2 FROM p)
SELECT auto_mask_id, [x1, y1, x2, y2]::INT[] AS united, round(least(x1, y1, 512 - x2, 512 - y2) / 512.0e0, 6) AS clearance FROM c"""
)
def united_boxes(spark, sf_dir):
    """The padded box around all sub-boxes of an image, and its distance to the border."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "settings")
    fine = F.filter("settings.qwen_sub_boxes_xyxy", lambda b: b.isNotNull() & (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull()))
    rows = rows.select("auto_mask_id", F.explode(F.array(L.united_box(fine, 512, 512, 0.1))).alias("united")).filter("united is not null")
    return rows.select("auto_mask_id", "united", F.round(L.clearance(F.col("united"), 512, 512), 6).alias("clearance"))


@query(
    """WITH r AS (SELECT DISTINCT 'data/' || category AS root FROM auto_mask_records WHERE category IS NOT NULL), d AS (SELECT DISTINCT regexp_replace(rel_path, '/[^/]*$', '') AS dir FROM artifact_inventory WHERE rel_path IS NOT NULL)
SELECT dir, root FROM d JOIN r ON dir = root OR starts_with(dir, root || '/') OR starts_with(root, dir || '/')"""
)
def path_containment(spark, sf_dir):
    """Directories of files that overlap a category's directory, either way."""
    roots = table(spark, sf_dir, "auto_mask_records").filter("category is not null").select(F.concat(F.lit("data/"), "category").alias("root")).distinct()
    dirs = table(spark, sf_dir, "artifact_inventory").filter("rel_path is not null").select(F.regexp_replace("rel_path", "/[^/]*$", "").alias("dir")).distinct()
    # overlapping paths agree up to the end of the shorter one, so they meet on their first two parts or on the one part they have
    head = lambda c, n: F.substring_index(F.col(c), "/", n)
    both = dirs.withColumn("k", F.explode(F.array_distinct(F.array(head("dir", 1), head("dir", 2))))).join(roots.withColumn("k", F.explode(F.array_distinct(F.array(head("root", 1), head("root", 2))))), "k")
    return both.filter(L.overlapping(F.col("dir"), F.col("root"))).select("dir", "root").distinct()


@query(
    f"""WITH {_ONE}, p AS (SELECT 'candidate_refined_paths.' || e.key AS key, e.value AS v FROM (SELECT unnest(map_entries(settings.candidate_refined_paths)) AS e FROM one)
  UNION ALL SELECT 'candidate_heatmap_paths.' || e.key, e.value FROM (SELECT unnest(map_entries(settings.candidate_heatmap_paths)) AS e FROM one) UNION ALL SELECT 'selected_refinement', settings.selected_refinement FROM one)
SELECT key, count(*) AS n_paths FROM p WHERE contains(v, '/') OR contains(v, '\\') OR regexp_matches(lower(v), '\\.(png|jpg|jpeg|bmp|tif|tiff|json|jsonl|yaml|yml)$') GROUP BY 1"""
)
def config_path_references(spark, sf_dir):
    """Paths named anywhere inside the settings, by dotted key."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "settings")
    maps = [_keyed(m) for m in ("candidate_refined_paths", "candidate_heatmap_paths")]
    single = F.array(F.struct(F.lit("selected_refinement").alias("key"), F.col("settings.selected_refinement").alias("value")))
    named = rows.select(F.explode(F.concat(*maps, single)).alias("e")).select("e.key", "e.value")
    looks = F.contains("value", F.lit("/")) | F.contains("value", F.lit("\\")) | F.lower("value").rlike(r"\.(png|jpg|jpeg|bmp|tif|tiff|json|jsonl|yaml|yml)\z")
    return named.filter(looks).groupBy("key").agg(F.count("*").alias("n_paths"))


def _keyed(name: str):
    entries = F.map_entries(f"settings.{name}")
    keyed = F.transform(entries, lambda e: F.struct(F.concat(F.lit(f"{name}."), e["key"]).alias("key"), e["value"].alias("value")))
    return F.coalesce(keyed, F.array().cast("array<struct<key: string, value: string>>"))


@query(
    f"""WITH {_GEN}, f AS (SELECT DISTINCT rel_path AS p FROM artifact_inventory), st AS (SELECT generation_id, latency_sec AS stored_latency FROM gen WHERE error IS NULL)
SELECT g.generation_id, CASE WHEN output_path IS NULL OR output_path NOT IN (SELECT p FROM f WHERE p IS NOT NULL) THEN 'compute' ELSE 'carry' END AS action,
  round(CASE WHEN output_path IN (SELECT p FROM f) THEN CASE WHEN isnan(stored_latency) THEN NULL ELSE stored_latency END END, 6) AS stored_latency
FROM gen g LEFT JOIN st USING (generation_id) WHERE output_path IS NULL OR output_path NOT IN (SELECT p FROM f WHERE p IS NOT NULL) OR st.generation_id IS NOT NULL"""
)
def incremental_merge(spark, sf_dir):
    """What a rerun computes, carries over with its stored value, or leaves out; records without error have a stored row."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "output_path", "error", "latency_sec")
    stored = rows.filter("error is null").select("generation_id", F.col("latency_sec").alias("stored_latency"))
    files = table(spark, sf_dir, "artifact_inventory").select(F.col("rel_path").alias("path"))
    done = L.carried_rows(rows.select("generation_id", "output_path"), stored, ["generation_id"], "output_path", files)
    return done.select("generation_id", "action", F.round(F.when(~F.isnan("stored_latency"), F.col("stored_latency")), 6).alias("stored_latency"))


@query(
    """WITH one AS (SELECT * FROM phase4_records WHERE phase4_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY phase4_id ORDER BY ingested_at) = 1),
a AS (SELECT phase4_id, generation_seed, greatest(0, coalesce(critic_guided_generation.selected_repair_index, 0)) AS n, settings.quality_morphology AS m,
  (CASE WHEN quality_flags IS NULL THEN 0 ELSE len(quality_flags) END = 0 OR coalesce(tfidg_lite.adaptive_mask_coverage_score < 0.35, false)) AS low FROM one)
SELECT phase4_id, round(CASE WHEN n > 0 THEN least(0.85e0, 0.55e0 + 0.05e0 * n + CASE WHEN low THEN 0.03e0 ELSE 0 END) ELSE 0.55e0 END, 6) AS strength,
  (CASE WHEN n > 0 THEN least(40, 20 + 2 * n + CASE WHEN low THEN 2 ELSE 0 END) ELSE 20 END)::INT AS steps,
  round(CASE WHEN n > 0 AND low THEN least(0.08e0, 0.035e0 * n * CASE m WHEN 'single_stroke' THEN 0.9e0 WHEN 'multi_scuff' THEN 0.7e0 ELSE 1.0e0 END) ELSE 0 END, 6) AS noise,
  CASE WHEN n > 0 THEN generation_seed + 97531 * n ELSE generation_seed END AS seed FROM a"""
)
def retry_settings(spark, sf_dir):
    """Settings of each candidate's last attempt: its flags are the reasons noted, and too little coverage is one of them."""
    rows = R.once(table(spark, sf_dir, "phase4_records"), "phase4_id", "generation_seed", "critic_guided_generation", "settings", "quality_flags", "tfidg_lite")
    attempt = F.greatest(F.lit(0), F.coalesce("critic_guided_generation.selected_repair_index", F.lit(0)))
    low = F.coalesce(F.col("tfidg_lite.adaptive_mask_coverage_score") < 0.35, F.lit(False))
    refused = F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), F.when(low, F.array(F.lit("low_mask_coverage"))).otherwise(F.array().cast("array<string>")))
    again = L.retry_settings(attempt, refused, F.col("settings.quality_morphology"), F.lit(0.55), F.lit(7.5), F.lit(20), F.col("generation_seed"), L.RetrySettings())
    rows = rows.select("phase4_id", again.alias("s"))
    return rows.select("phase4_id", F.round("s.strength", 6).alias("strength"), "s.steps", F.round("s.noise", 6).alias("noise"), "s.seed")
