"""Further measures of masks, images and records: scores, roles, losses, routing, listings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.functions import scores as P
from tesserae.operators import kernels as K
from tesserae.operators import raster as G
from tesserae.operators import relational as R
from tesserae.plans.candidates import sql_finite
from tesserae.plans.rasters import _PX, images
from tesserae.operators.quantiles import exact_quantiles
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


_ONE = "one AS (SELECT * FROM phase4_records QUALIFY row_number() OVER (PARTITION BY phase4_id ORDER BY ingested_at) = 1)"
_CF, _OUT, _L1, _IN = (sql_finite(x) for x in ("tfidg_lite.adaptive_mask_coverage_fraction", "outside_refined_change_fraction", "background_preservation_l1", "inpaint_mask_area_fraction"))


def _phase4(spark, sf_dir, *columns):
    return R.once(table(spark, sf_dir, "phase4_records"), "phase4_id", *columns)


@query(
    f"""WITH {_ONE}, c AS (SELECT phase4_id, {_CF} AS cf, {_OUT} AS o, {_L1} AS l, {_IN} AS i, {sql_finite('tfidg_lite.feature_alignment_score')} AS a FROM one WHERE tfidg_lite IS NOT NULL),
s AS (SELECT phase4_id, a, CASE WHEN cf <= 0.38 THEN greatest(0.0e0, cf / 0.38e0) ELSE greatest(0.0e0, 1 - greatest(0.0e0, cf - 0.92e0) / 0.25e0) END AS cov,
 greatest(0.0e0, least(1.0e0, 1 - 8 * l - 2.5e0 * (l / 2))) AS tex, greatest(0.0e0, least(1.0e0, 0.75e0 * (1 - o / 0.18e0) + 0.25e0 * (1 - greatest(0.0e0, i - 0.35e0) / 0.45e0))) AS leak FROM c)
SELECT phase4_id, round(cov, 6) + 0.0e0 AS coverage, round(tex, 6) + 0.0e0 AS texture, round(leak, 6) + 0.0e0 AS leakage,
 round(greatest(0.0e0, least(1.0e0, (a * 0.32e0 + cov * 0.22e0 + tex * 0.24e0 + leak * 0.14e0) / 0.92e0)), 5) + 0.0e0 AS critic FROM s"""
)
def critic_components(spark, sf_dir):
    """The critic's parts and their weighted mean."""
    rows = _phase4(spark, sf_dir, "tfidg_lite", "outside_refined_change_fraction", "background_preservation_l1", "inpaint_mask_area_fraction").filter("tfidg_lite is not null")
    n = lambda c: S.safe_number(F.col(c))
    l1 = n("background_preservation_l1")
    parts = {
        "alignment": n("tfidg_lite.feature_alignment_score"), "coverage": P.coverage_score(n("tfidg_lite.adaptive_mask_coverage_fraction")),
        "texture": P.texture_score(l1, l1 / 2), "leakage": P.leakage_score(n("outside_refined_change_fraction"), n("inpaint_mask_area_fraction")),
    }
    shown = [(F.round(parts[k], 6) + 0.0).alias(k) for k in ("coverage", "texture", "leakage")]
    return rows.select("phase4_id", *shown, (F.round(P.critic_score(parts), 5) + 0.0).alias("critic"))


@query(
    """WITH one AS (SELECT * FROM auto_mask_records QUALIFY row_number() OVER (PARTITION BY auto_mask_id ORDER BY ingested_at) = 1),
q AS (SELECT auto_mask_id, settings.quality_morphology AS m, unnest(map_entries(settings.candidate_qc)) AS e FROM one),
c AS (SELECT auto_mask_id, e.key AS mode, m, e.value.mask_to_qwen_box_fraction AS f, e.value.component_count AS n FROM q WHERE e.value.mask_to_qwen_box_fraction IS NOT NULL AND e.value.component_count IS NOT NULL AND m IS NOT NULL),
b AS (SELECT *, CASE WHEN m = 'multi_scuff' THEN 0.025e0 ELSE 0.004e0 END AS lo, CASE WHEN m = 'multi_scuff' THEN 0.24e0 ELSE 0.22e0 END AS hi, CASE WHEN m = 'multi_scuff' THEN 18 ELSE 8 END AS k FROM c)
SELECT auto_mask_id, mode, round(CASE WHEN f BETWEEN lo AND hi THEN 1.0e0 WHEN f < lo THEN greatest(0.0e0, f / lo) ELSE greatest(0.0e0, 1 - (f - hi) / hi) END, 6) AS area,
 round(greatest(0.0e0, 1 - greatest(0, n - k) / 20.0e0), 6) AS fragmentation FROM b"""
)
def area_and_fragmentation(spark, sf_dir):
    """Whether a candidate's area and number of parts are usual for its morphology."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "settings")
    long = rows.select("auto_mask_id", F.col("settings.quality_morphology").alias("m"), F.explode("settings.candidate_qc").alias("mode", "qc"))
    long = long.filter("qc.mask_to_qwen_box_fraction is not null and qc.component_count is not null and m is not null")
    area = P.area_score(F.col("qc.mask_to_qwen_box_fraction"), F.col("m"))
    return long.select("auto_mask_id", "mode", F.round(area, 6).alias("area"), F.round(P.fragmentation_score(F.col("qc.component_count"), F.col("m")), 6).alias("fragmentation"))


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT min(vec_id) AS first, label FROM e GROUP BY 2), r AS (SELECT e.label, e.v FROM e JOIN c ON e.vec_id = c.first)
SELECT e.vec_id, round(exp(-2.4e0 * list_distance(e.v, r.v) / sqrt(64)), 5) AS alignment FROM e JOIN r USING (label)"""
)
def feature_alignment(spark, sf_dir):
    """How alike each vector is to the first of its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    ref = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("r"))
    return e.join(ref, "label").select("vec_id", F.round(P.alignment_score(F.col("v"), F.col("r")), 5).alias("alignment"))


@query("SELECT l_returnflag, round(sum(l_tax * l_discount) / sum(l_tax), 6) AS mean, round(sqrt(greatest(0.0e0, sum(l_tax * l_discount * l_discount) / sum(l_tax) - pow(sum(l_tax * l_discount) / sum(l_tax), 2))), 5) AS std FROM lineitem GROUP BY 1")
def weighted_stats(spark, sf_dir):
    """Weighted mean and population deviation."""
    w, x = F.col("l_tax"), F.col("l_discount")
    mean = F.sum(w * x) / F.sum(w)
    var = F.sum(w * x * x) / F.sum(w) - mean * mean
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), var)), 5).alias("std"))


@query(f"WITH {_PX}, c AS (SELECT id, count(*) FILTER (v >= 0.2) AS p, count(*) AS n FROM px GROUP BY id) SELECT id, round(CASE WHEN p > 0 THEN least(12.0e0, greatest(1.0e0, (n - p) / p::DOUBLE)) ELSE 1.0e0 END, 6) AS weight FROM c")
def class_weight(spark, sf_dir):
    """How much more a bright cell weighs in its image."""
    bright = F.size(F.filter("values", lambda v: v >= 0.2))
    return images(spark, sf_dir).select("id", F.round(P.balance_weight(bright, F.size("values"), 12.0), 6).alias("weight"))


@query(f"WITH {_PX}, s AS (SELECT id, avg(v) FILTER (v >= 0.1) AS a, avg(v) FILTER (v < 0.1) AS b, stddev_pop(v) FILTER (v < 0.1) AS d FROM px GROUP BY id) SELECT id, round(abs(a - b) / (d + 1e-6), 4) AS snr, round(abs(a - b) / (d + 1e-6), 4) > 5 AS stops FROM s")
def signal_to_noise(spark, sf_dir):
    """Distance of mask and ground in units of the ground's spread; above five no further candidate is tried."""

    def run(ids, s):
        m = s >= 0.1
        n, k = m.sum((1, 2)), (~m).sum((1, 2))
        a, b = (s * m).sum((1, 2)) / n, (s * ~m).sum((1, 2)) / k
        d = np.sqrt((((s - b[:, None, None]) ** 2) * ~m).sum((1, 2)) / k)
        snr = np.round(np.abs(a - b) / (d + 1e-6), 4)
        return pd.DataFrame({"id": ids, "snr": snr, "stops": snr > 5})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, snr double, stops boolean")


_NORM = f"{_PX}, r AS (SELECT id, min(v) AS lo, max(v) AS hi FROM px GROUP BY id), nx AS (SELECT px.id, pos, x, y, v, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.0e0 END AS u FROM px JOIN r USING (id))"


@query(f"WITH {_NORM}, s AS (SELECT id, sum(u * v) FILTER (v >= 0.1) / sum(v) FILTER (v >= 0.1) AS a, avg(u) FILTER (v < 0.1) AS b FROM nx GROUP BY id) SELECT id, round(greatest(0.0e0, least(1.0e0, a - 0.35e0 * coalesce(b, 0))), 5) AS support FROM s")
def heat_support(spark, sf_dir):
    """Weighted heat inside the mask less a third of that outside."""

    def run(ids, s):
        u, m = K.normalised(s), s >= 0.1
        inside = (u * s * m).sum((1, 2)) / (s * m).sum((1, 2))
        outside = (u * ~m).sum((1, 2)) / np.maximum((~m).sum((1, 2)), 1)
        return pd.DataFrame({"id": ids, "support": np.round(np.clip(inside - 0.35 * outside, 0, 1), 5)})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, support double")


@query(f"WITH {_NORM}, q AS (SELECT id, quantile_cont(u, 0.9) AS hi, quantile_cont(u, 0.5) AS lo FROM nx GROUP BY id) SELECT id, count(*) FILTER (u >= hi) AS positive, count(*) FILTER (u <= lo) AS negative, count(*) FILTER (u > lo AND u < hi) AS ignored FROM nx JOIN q USING (id) GROUP BY id")
def teacher_extremes(spark, sf_dir):
    """Cells a teacher is sure of, and those left out."""

    def run(ids, s):
        u = K.normalised(s)
        hi, lo = np.quantile(u, 0.9, axis=(1, 2), keepdims=True), np.quantile(u, 0.5, axis=(1, 2), keepdims=True)
        return pd.DataFrame({"id": ids, "positive": (u >= hi).sum((1, 2)), "negative": (u <= lo).sum((1, 2)), "ignored": ((u > lo) & (u < hi)).sum((1, 2))})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, positive bigint, negative bigint, ignored bigint")


@query(
    f"""WITH {_NORM}, t AS (SELECT *, (v >= 0.1)::INT AS t, least(1 - 1e-6, greatest(1e-6, u)) AS p FROM nx)
SELECT id, round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 5) AS bce, round(1 - (2 * sum(u * t) + 1e-6) / (sum(u) + sum(t) + 1e-6), 5) AS soft_dice, round(pow(avg(u) - avg(t), 2), 5) AS area FROM t GROUP BY id"""
)
def loss_metrics(spark, sf_dir):
    """Cross entropy, soft Dice and area error of a score map against a mask."""

    def run(ids, s):
        u, t = K.normalised(s), (s >= 0.1).astype(float)
        p = np.clip(u, 1e-6, 1 - 1e-6)
        bce = -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean((1, 2))
        dice = 1 - (2 * (u * t).sum((1, 2)) + 1e-6) / (u.sum((1, 2)) + t.sum((1, 2)) + 1e-6)
        return pd.DataFrame({"id": ids, "bce": np.round(bce, 5), "soft_dice": np.round(dice, 5), "area": np.round((u.mean((1, 2)) - t.mean((1, 2))) ** 2, 5)})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, bce double, soft_dice double, area double")


@query(
    f"""WITH {_NORM}, z AS (SELECT *, abs(x - 3.5e0) + abs(y - 3.5e0) <= 5 AS sel, 0.1e0 AS unc FROM nx)
SELECT id, count(*) FILTER (u >= 0.8 AND sel) AS core, count(*) FILTER (u >= 0.35 OR sel) AS possible, round(sum(CASE WHEN u >= 0.35 OR sel THEN greatest(0.0e0, least(1.0e0, u * (1 - 0.75e0 * unc))) ELSE 0 END), 5) AS soft FROM z GROUP BY id"""
)
def mask_roles(spark, sf_dir):
    """Sizes of the sure, the possible and the soft mask around a selected region."""

    def run(ids, s):
        u = K.normalised(s)
        _, h, w = u.shape
        selected = np.abs(np.arange(w)[None, None, :] - (w - 1) / 2) + np.abs(np.arange(h)[None, :, None] - (h - 1) / 2) <= 5
        possible = (u >= 0.35) | selected
        soft = np.clip(u * (1 - 0.75 * 0.1), 0, 1) * possible
        return pd.DataFrame({"id": ids, "core": ((u >= 0.8) & selected).sum((1, 2)), "possible": possible.sum((1, 2)), "soft": np.round(soft.sum((1, 2)), 5)})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, core bigint, possible bigint, soft double")


@query(f"WITH {_PX}, s AS (SELECT id, x // 2 AS bx, y // 2 AS bb, avg(v) AS m FROM px GROUP BY ALL) SELECT px.id, round(corr(v, m), 5) AS consistency FROM px JOIN s ON s.id = px.id AND bx = x // 2 AND bb = y // 2 GROUP BY px.id")
def scale_consistency(spark, sf_dir):
    """How well the image at half size explains the image."""

    def run(ids, s):
        n, h, w = s.shape
        half = s.reshape(n, h // 2, 2, w // 2, 2).mean((2, 4)).repeat(2, 1).repeat(2, 2)
        a, b = s - s.mean((1, 2), keepdims=True), half - half.mean((1, 2), keepdims=True)
        return pd.DataFrame({"id": ids, "consistency": np.round((a * b).sum((1, 2)) / np.sqrt((a * a).sum((1, 2)) * (b * b).sum((1, 2))), 5)})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, consistency double")


@query(f"WITH {_PX}, m AS (SELECT pos, median(v) AS med FROM px GROUP BY 1) SELECT pos::INT AS pos, round(med, 6) AS med, med >= 0 AS foreground FROM m")
def foreground_consensus(spark, sf_dir):
    """The median image of all, and which cells it calls foreground."""
    cells = images(spark, sf_dir).select(F.posexplode("values").alias("pos", "v"))
    medians = exact_quantiles(cells, ["pos"], "v", [0.5]).withColumn("m", F.col("q")[0])
    return medians.select("pos", F.round("m", 6).alias("med"), (F.col("m") >= 0).alias("foreground"))


@query(
    """WITH k AS (SELECT vec_id AS id, string_agg(CASE WHEN embedding[i]::DOUBLE >= 0.25 THEN '1' ELSE '0' END, '' ORDER BY i) AS b FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1)
SELECT min(id) AS id, count(*) AS copies FROM k GROUP BY b"""
)
def identical_masks(spark, sf_dir):
    """One image per different mask, and how many have it."""
    bits = F.array_join(F.transform("values", lambda v: F.when(v >= 0.25, "1").otherwise("0")), "")
    return images(spark, sf_dir).select("id", bits.alias("b")).groupBy("b").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")


@query("SELECT event_id FROM events ORDER BY sha256('pick|' || event_id), event_id LIMIT 200")
def hash_sample(spark, sf_dir):
    """200 events by hash: the same ones however the data lies."""
    return table(spark, sf_dir, "events").select("event_id").orderBy(F.sha2(F.concat(F.lit("pick|"), F.col("event_id").cast("string")), 256), "event_id").limit(200)


@query(
    """WITH g AS (SELECT generation_id, any_value(model) AS model FROM generation_records GROUP BY 1), a(model, policy) AS (VALUES ('sd15', 'allowed'), ('sd15_gated', 'allowed'), ('mock', 'development_only'))
SELECT model, coalesce(policy, 'forbidden') AS policy, count(*) AS n_rows FROM g LEFT JOIN a USING (model) GROUP BY ALL"""
)
def policy_lookup(spark, sf_dir):
    """What each generator may be used for; one that is not listed is forbidden."""
    dim = spark.createDataFrame([("sd15", "allowed"), ("sd15_gated", "allowed"), ("mock", "development_only")], "model string, policy string")
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "model")
    return rows.join(F.broadcast(dim), "model", "left").groupBy("model", F.coalesce("policy", F.lit("forbidden")).alias("policy")).agg(F.count("*").alias("n_rows"))


@query(
    """WITH one AS (SELECT * FROM auto_mask_records QUALIFY row_number() OVER (PARTITION BY auto_mask_id ORDER BY ingested_at) = 1), p AS (SELECT auto_mask_id, unnest(settings.candidate_predictions) AS p FROM one)
SELECT p.disposition AS disposition, count(*) AS n_rows, count(*) FILTER (p.expected_iou IS NULL OR isnan(p.expected_iou) OR p.expected_iou < 0 OR p.expected_iou > 1) AS n_bad_iou FROM p WHERE p IS NOT NULL GROUP BY 1"""
)
def value_invariants(spark, sf_dir):
    """Predictions per disposition, and how many have an overlap that is none."""
    rows = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "settings")
    p = rows.select(F.explode("settings.candidate_predictions").alias("p")).filter("p is not null").select("p.disposition", F.col("p.expected_iou").alias("iou"))
    bad = F.count_if(F.coalesce(F.isnan("iou") | (F.col("iou") < 0) | (F.col("iou") > 1), F.lit(True)) | F.col("iou").isNull())
    return p.groupBy("disposition").agg(F.count("*").alias("n_rows"), bad.alias("n_bad_iou"))


@query(
    """WITH g AS (SELECT generation_id, any_value(settings) AS s, any_value(category) AS c FROM generation_records GROUP BY 1)
SELECT generation_id, coalesce(s.placement_mode, 'surface_constrained') AS placement, coalesce(s.num_inference_steps::VARCHAR, '30') AS steps, coalesce(c, 'any') AS category FROM g"""
)
def dict_merge(spark, sf_dir):
    """Settings laid over defaults; what is given wins."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "settings", "category")
    given = F.map_filter(
        F.create_map(F.lit("placement"), F.col("settings.placement_mode"), F.lit("steps"), F.col("settings.num_inference_steps").cast("string"), F.lit("category"), F.col("category")),
        lambda k, v: v.isNotNull(),
    )
    defaults = F.create_map(F.lit("placement"), F.lit("surface_constrained"), F.lit("steps"), F.lit("30"), F.lit("category"), F.lit("any"))
    merged = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(F.col("given"), k)), F.col("given"))
    rows = rows.withColumn("given", given).withColumn("m", merged)
    return rows.select("generation_id", *[F.col("m")[k].alias(k) for k in ("placement", "steps", "category")])


@query(
    """WITH g AS (SELECT generation_id, any_value(settings) AS s FROM generation_records GROUP BY 1), w AS (SELECT generation_id, unnest(string_split(s.prompt, ' ')) AS word FROM g)
SELECT word, count(*) AS n_rows FROM w WHERE word <> '' GROUP BY 1"""
)
def split_explode(spark, sf_dir):
    """How often each word stands in the prompts."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "settings")
    words = rows.select(F.explode(F.split("settings.prompt", " ")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n_rows"))


@query(
    f"""WITH {_ONE}, s AS (SELECT variant, quality_profile, count(*) AS n_rows, round(avg({sql_finite('generation_quality_score')}), 9) AS mean_score, count(*) FILTER (len(quality_flags) = 0) AS accepted FROM one GROUP BY ALL)
SELECT *, (row_number() OVER (ORDER BY mean_score DESC, variant NULLS FIRST, quality_profile NULLS FIRST))::INT AS place FROM s"""
)
def group_report(spark, sf_dir):
    """Variants and profiles by mean score; the last window sees one row per group."""
    from pyspark.sql import Window

    rows = _phase4(spark, sf_dir, "variant", "quality_profile", "generation_quality_score", "quality_flags")
    score = S.safe_number(F.col("generation_quality_score"))
    rep = rows.groupBy("variant", "quality_profile").agg(F.count("*").alias("n_rows"), F.round(F.avg(score), 9).alias("mean_score"), F.count_if(F.size("quality_flags") == 0).alias("accepted"))
    return rep.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_score").desc(), "variant", "quality_profile")))


@query("SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 25")
def best_listing(spark, sf_dir):
    """The 25 highest values; a report, so the limit is the feature."""
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", "user_id", "value").orderBy(F.col("value").desc(), "event_id").limit(25)


@query(
    """WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT count(*) AS n_rows, count(b.v) AS n_matched, round(avg(a.v) FILTER (b.v IS NOT NULL) - avg(b.v), 6) AS gain FROM a LEFT JOIN b USING (user_id)"""
)
def baseline_compare(spark, sf_dir):
    """Mean gain over a baseline, over matched users only."""
    e = table(spark, sf_dir, "events")
    mean = lambda t, n: e.filter(F.col("event_type") == t).groupBy("user_id").agg(F.avg("value").alias(n))
    both = mean("click", "a").join(mean("view", "b"), "user_id", "left")
    gain = F.avg(F.when(F.col("b").isNotNull(), F.col("a"))) - F.avg("b")
    return both.agg(F.count("*").alias("n_rows"), F.count("b").alias("n_matched"), F.round(gain, 6).alias("gain"))


@query(f"WITH {_PX}, t AS (SELECT id, x // 2 AS nx, y // 2 AS ny, v FROM px WHERE x % 2 = 1 AND y % 2 = 1) SELECT id, count(*) AS cells, round(sum(v * (1 + nx + 4 * ny)), 5) AS checksum FROM t GROUP BY id")
def nearest_resize(spark, sf_dir):
    """Images at half size by nearest cell, as a checksum."""

    def run(ids, s):
        n, h, w = s.shape
        rows, cols = ((np.arange(h // 2) + 0.5) * 2).astype(int), ((np.arange(w // 2) + 0.5) * 2).astype(int)
        small = s[:, rows][:, :, cols]
        weight = 1 + np.arange(w // 2)[None, :] + (w // 2) * np.arange(h // 2)[:, None]
        return pd.DataFrame({"id": ids, "cells": small[0].size, "checksum": np.round((small * weight).sum((1, 2)), 5)})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, cells bigint, checksum double")


@query(
    f"""WITH {_PX}, w AS (SELECT px.id, t.top, avg(v) AS m, max(v) AS hi FROM px JOIN generate_series(0, 5) t(top) ON px.y >= t.top AND px.y < t.top + 3 GROUP BY ALL),
s AS (SELECT id, top::INT AS top, round(0.65e0 * hi + 0.35e0 * m, 9) AS score FROM w) SELECT id, top, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s.score DESC, top) = 1"""
)
def sliding_windows(spark, sf_dir):
    """The best band of three rows in each image."""

    def run(ids, s):
        band = np.lib.stride_tricks.sliding_window_view(s, 3, axis=1)  # n, tops, w, 3
        score = np.round(0.65 * band.max((2, 3)) + 0.35 * band.mean((2, 3)), 9)
        top = score.argmax(1)
        return pd.DataFrame({"id": ids, "top": top, "score": np.round(score[np.arange(len(ids)), top], 5)})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, top int, score double")


@query(
    """WITH s AS (SELECT category || '/' || defect_type AS k, count(DISTINCT sample_id) AS n, count(DISTINCT split) AS splits FROM anomaly_samples WHERE split IS NOT NULL AND category IS NOT NULL AND defect_type IS NOT NULL GROUP BY 1)
SELECT k AS target, n AS n_samples, CASE WHEN splits < 3 THEN 'incomplete' ELSE 'complete' END AS state FROM s"""
)
def target_coverage(spark, sf_dir):
    """Samples per target, and whether every split has some."""
    rows = table(spark, sf_dir, "anomaly_samples").filter("split is not null and category is not null and defect_type is not null")
    per = rows.groupBy(F.concat_ws("/", "category", "defect_type").alias("target")).agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("split").alias("splits"))
    return per.select("target", "n_samples", F.when(F.col("splits") < 3, "incomplete").otherwise("complete").alias("state"))
