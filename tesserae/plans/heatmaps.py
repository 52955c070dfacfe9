"""Queries on heatmaps: the 8 x 8 images of ``rasters``, those of label 0 being the normal ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import heatmaps as H
from tesserae.operators import kernels as K
from tesserae.operators.raster import map_rasters
from tesserae.plans.rasters import _PX, images
from tesserae.session import table

QUERIES: dict = {}
SQL: dict = {}
NORMALS = 8


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).join(table(spark, sf_dir, "embeddings").filter("label = 0").select(F.col("vec_id").alias("id")), "id", "left_semi")


def _against(spark: SparkSession, sf_dir: str, kernel: Callable, schema: str) -> DataFrame:
    return H.against_normals(images(spark, sf_dir), _normals(spark, sf_dir), kernel, schema, NORMALS)


_MAP = "id bigint, values array<double>"


def _maps(spark: SparkSession, sf_dir: str, heat: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    run = lambda ids, x, memory: pd.DataFrame({"id": ids, "values": list(np.round(heat(x, memory), 6).reshape(len(x), -1))})
    return _against(spark, sf_dir, run, _MAP)


@query()
def texture_anomaly(spark, sf_dir):
    """Where contrast, edges and detail are not those of normal images."""
    return _maps(spark, sf_dir, H.texture_anomaly)


@query()
def memory_heatmap(spark, sf_dir):
    """How far each patch is from any normal one."""
    return _maps(spark, sf_dir, H.memory_heatmap)


@query()
def mutual_heatmap(spark, sf_dir):
    """Distance to normal patches, weighed by how alike the image's own patches are."""
    return _maps(spark, sf_dir, H.mutual_heatmap)


@query()
def residual_heatmap(spark, sf_dir):
    """Difference to the most similar window of a normal image."""
    return _maps(spark, sf_dir, H.residual_heatmap)


_NORMAL = f"{_PX}, few AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS nth FROM embeddings WHERE label = 0 QUALIFY nth < {NORMALS}), m AS (SELECT nth, pos, v FROM px JOIN few USING (id))"


@query(
    f"""WITH {_NORMAL}, d AS (SELECT px.id, m.nth, avg(abs(px.v - m.v)) AS apart FROM px JOIN m USING (pos) GROUP BY ALL)
SELECT id, arg_min(nth, (round(apart, 9), nth))::INT AS nearest, round(min(apart), 6) AS apart FROM d GROUP BY id"""
)
def nearest_normal(spark, sf_dir):
    """The normal image most like each image."""

    def run(ids, x, memory):
        apart = np.round(np.stack([np.abs(x - m).mean(axis=(1, 2)) for m in memory], axis=1), 9)
        return pd.DataFrame({"id": ids, "nearest": apart.argmin(axis=1).astype(np.int32), "apart": np.round(H.nearest_normal(x, memory)[1], 6)})

    return _against(spark, sf_dir, run, "id bigint, nearest int, apart double")


@query()
def template_match(spark, sf_dir):
    """The normal window most like the middle of each image, over all offsets up to two cells."""

    def run(ids, x, memory):
        normal, dy, dx, score, _ = H.best_window(x, memory, (2, 2, 6, 6), 2, 1)
        return pd.DataFrame({"id": ids, "normal": normal, "dy": dy, "dx": dx, "score": np.round(score, 6)})

    return _against(spark, sf_dir, run, "id bigint, normal int, dy int, dx int, score double")


#: One builder per mode: heat of a stack against the normal images.
BUILDERS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "normal_anomaly": H.texture_anomaly, "nearest_normal_residual": H.residual_heatmap, "patchcore_guided": H.memory_heatmap, "musc_mutual_score": H.mutual_heatmap,
    "fft_texture_suppression": lambda x, m: K.fft_notch(x), "structure_tensor_ridge": lambda x, m: K.structure_ridge(x), "pixel": lambda x, m: K.normalised(x),
    "residual": lambda x, m: K.normalised(np.abs(x - K.gaussian(x, 3.0))),
}
PERCENTILES = {"nearest_normal_residual": 92.0, "patchcore_guided": 88.0, "musc_mutual_score": 88.0, "fft_texture_suppression": 93.0}


def built_candidates(ids: np.ndarray, x: np.ndarray, memory: np.ndarray, builders: dict[str, Callable] | None = None) -> pd.DataFrame:
    """One row per image and mode: (id, mode, ok, error, area, components, box_fraction, mean_heat); a mode that fails gives rows that say why."""
    rows, masks = [], []
    for mode, build in (builders or BUILDERS).items():
        try:
            heat = build(x, memory)
            mask = H.mask_from_heat(heat, PERCENTILES.get(mode, 90.0))
        except Exception as e:  # noqa: BLE001 - one provider's failure is its own
            rows += [(i, mode, False, f"{type(e).__name__}: {e}", None, None, None, None) for i in ids]
            continue
        masks.append(mask)
        rows += _measured(ids, mode, mask, heat)
    if len(masks) > 1:
        stack = np.stack(masks)
        votes = stack.mean(axis=0)
        rows += _measured(ids, "normal_residual_fusion", H.fused_mask(stack[:4], 2), votes)
        rows += _measured(ids, "support_constrained_fusion", H.fused_mask(stack, 3, votes >= 0.5), votes)
        rows += _measured(ids, "ensemble_consensus", H.fused_mask(stack, (len(masks) + 1) // 2), votes)
    return pd.DataFrame(rows, columns=["id", "mode", "ok", "error", "area", "components", "box_fraction", "mean_heat"])


def _measured(ids: np.ndarray, mode: str, mask: np.ndarray, heat: np.ndarray) -> list[tuple]:
    label = K.components(mask, True)
    out = []
    for i, m, l, h in zip(ids, mask, label, heat):
        out.append((i, mode, True, None, int(m.sum()), int(len(np.unique(l[l >= 0]))), round(float(m.mean()), 6), round(float(h[m].mean()), 6) if m.any() else None))
    return out


@query()
def candidate_builder(spark, sf_dir):
    """All modes' candidates of every image in one long table; a failure of one leaves the others."""
    schema = "id bigint, mode string, ok boolean, error string, area int, components int, box_fraction double, mean_heat double"
    return _against(spark, sf_dir, built_candidates, schema)


@query(
    f"""WITH {_PX}, lim AS (SELECT id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), u AS (SELECT id, y, x, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS u FROM px JOIN lim USING (id)),
s AS (SELECT a.id, a.y, a.x, a.u AS a, b.u AS b, c.u AS c FROM u a JOIN u b ON b.id = a.id AND b.y = a.y AND b.x = 7 - a.x JOIN u c ON c.id = a.id AND c.y = 7 - a.y AND c.x = a.x)
SELECT id, round(sum(0.58e0 * (a + b + c) / 3 + 0.27e0 * greatest(a, b, c) + 0.15e0 * (1 - (greatest(a, b, c) - least(a, b, c)))), 5) AS total FROM s GROUP BY id"""
)
def weighted_fusion(spark, sf_dir):
    """An image, its mirror image and its upturned image as one evidence map; its total."""

    def run(ids, x):
        u = K.normalised(x)
        three = np.stack([u, u[:, :, ::-1], u[:, ::-1]])
        fused = H.weighted_fusion(three.mean(axis=0), three.max(axis=0), 1 - (three.max(axis=0) - three.min(axis=0)))
        return pd.DataFrame({"id": ids, "total": np.round(fused.sum((1, 2)), 5)})

    return map_rasters(images(spark, sf_dir), run, "id bigint, total double")


@query(
    f"""WITH {_PX}, g AS (SELECT id, y, x, 127.5e0 * (1 + v) AS g, v >= 0.1 AS m FROM px), c AS (SELECT a.id, a.m, abs(a.g - b.g) AS d FROM g a JOIN g b ON b.id = a.id AND b.y = a.y AND b.x = 7 - a.x)
SELECT id, round(avg(d) FILTER (NOT m) / 255, 6) AS outside_l1, round(avg(d) FILTER (m) / 255, 6) AS visibility, round(avg((d > 12)::INT) FILTER (NOT m), 6) AS leakage FROM c GROUP BY id"""
)
def change_measures(spark, sf_dir):
    """What changed inside and outside the bright cells from an image to its mirror image."""

    def run(ids, x):
        g = 127.5 * (1 + x)
        return pd.concat([pd.Series(ids, name="id"), H.change_measures(g, g[:, :, ::-1], x >= 0.1).round(6)], axis=1)

    return map_rasters(images(spark, sf_dir), run, "id bigint, outside_l1 double, visibility double, leakage double")


@query(
    f"""WITH {_PX}, f AS (SELECT id, y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AS b, v >= 0.1 AND y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AS r, v >= 0.05 AS i, y >= 3 AS s FROM px),
n AS (SELECT id, count(*) FILTER (b) AS b, count(*) FILTER (r) AS r, count(*) FILTER (i) AS i, count(*) FILTER (r AND s) AS rs, count(*) FILTER (i AND NOT s) AS off FROM f GROUP BY id)
SELECT id, b / 64.0e0 AS box_area_fraction, r / 64.0e0 AS refined_area_fraction, round(r / b, 6) AS refined_to_box_area, CASE WHEN r > 0 THEN round(rs / r, 6) END AS refined_surface_coverage,
  CASE WHEN r > 0 THEN round((r - rs) / r, 6) END AS refined_off_surface_fraction, CASE WHEN r > 0 THEN round(i / r, 6) END AS inpaint_to_refined_area, CASE WHEN i > 0 THEN round(off / i, 6) END AS inpaint_off_surface_fraction FROM n"""
)
def placement_measures(spark, sf_dir):
    """Shares of a box, the bright cells in it, the cells to paint and the surface below the third row."""

    def run(ids, x):
        box, surface = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
        box[:, 2:6, 2:6], surface[:, 3:] = True, True
        return pd.concat([pd.Series(ids, name="id"), H.placement_measures(box, (x >= 0.1) & box, x >= 0.05, surface).round(6)], axis=1)

    names = ("box_area_fraction", "refined_area_fraction", "refined_to_box_area", "refined_surface_coverage", "refined_off_surface_fraction", "inpaint_to_refined_area", "inpaint_off_surface_fraction")
    return map_rasters(images(spark, sf_dir), run, "id bigint, " + ", ".join(f"{n} double" for n in names))


@query()
def ten_mask_roles(spark, sf_dir):
    """Sizes of the ten masks that a decision on each image's brightest area gives."""

    def run(ids, x):
        fused = K.normalised(x)
        selected = H.mask_from_heat(fused, 85.0, most=1)
        roles = H.mask_roles(fused, np.abs(fused - fused[:, :, ::-1]) / 2, (fused >= 0.5) * 1.0, selected, selected.mean((1, 2)) < 0.1)
        return pd.DataFrame({"id": ids, **{k: np.round(np.asarray(v, float).sum((1, 2)), 5) for k, v in roles.items()}})

    names = ("generation_core", "eval_tight", "eval_mvtec", "training_medium", "training_wide", "training_soft", "positive_core", "possible_region", "uncertainty_map", "inpaint_soft")
    return map_rasters(images(spark, sf_dir), run, "id bigint, " + ", ".join(f"{n} double" for n in names))


@query()
def patch_vectors(spark, sf_dir):
    """Fourteen numbers for every patch of the grid."""

    def run(ids, x):
        f = H.patch_vectors(x, 5, 2)
        n, p, _ = f.shape
        return pd.DataFrame({"id": np.repeat(ids, p), "patch": np.tile(np.arange(p), n), "features": list(np.round(f, 6).reshape(n * p, -1))})

    return map_rasters(images(spark, sf_dir), run, "id bigint, patch int, features array<double>")


@query()
def offset_bins(spark, sf_dir):
    """Per image the ranges of brightness in which most of its cells lie, at most three."""

    def run(ids, x):
        rows = [(i, n, a, b) for i, image in zip(ids, x) for n, (a, b) in enumerate(H.offset_bins(image.ravel(), 3))]
        return pd.DataFrame(rows, columns=["id", "nth", "low", "high"])

    return map_rasters(images(spark, sf_dir), run, "id bigint, nth int, low double, high double")


@query(
    f"""WITH {_PX}, w AS (SELECT a, i, greatest(0.0e0, 1 - abs(i - (2 * a + 0.5e0)) / 2) AS w FROM generate_series(0, 3) g(a), generate_series(0, 7) h(i)), n AS (SELECT a, i, w / sum(w) OVER (PARTITION BY a) AS w FROM w)
SELECT id, y.a::INT AS y, x.a::INT AS x, round(sum(y.w * x.w * v), 6) AS v FROM px JOIN n y ON y.i = px.y JOIN n x ON x.i = px.x GROUP BY id, y.a, x.a"""
)
def resized(spark, sf_dir):
    """Images at half their height and width, cell by cell."""

    def run(ids, x):
        small = np.round(K.resized(x, 4, 4), 6)
        n, h, w = small.shape
        return pd.DataFrame({"id": np.repeat(ids, h * w), "y": np.tile(np.repeat(np.arange(h), w), n).astype(np.int32), "x": np.tile(np.arange(w), n * h).astype(np.int32), "v": small.ravel()})

    return map_rasters(images(spark, sf_dir), run, "id bigint, y int, x int, v double")


@query(
    f"""WITH {_PX}, s AS (SELECT id, y, quantile_cont(v, 0.98) AS q, max(v) AS m FROM (SELECT id, y, v FROM px UNION ALL SELECT id, y - 1, v FROM px WHERE y > 0 UNION ALL SELECT id, y - 2, v FROM px WHERE y > 1) WHERE y <= 5 GROUP BY ALL)
SELECT id, y::INT AS top, round(0.65e0 * q + 0.35e0 * m, 6) AS score FROM s"""
)
def window_scores(spark, sf_dir):
    """Scores of windows of three rows slid down every image."""

    def run(ids, x):
        tops, scores = H.window_scores(x, 3, 1)
        return pd.DataFrame({"id": np.repeat(ids, len(tops)), "top": np.tile(tops, len(ids)).astype(np.int32), "score": np.round(scores.ravel(), 6)})

    return map_rasters(images(spark, sf_dir), run, "id bigint, top int, score double")


@query(
    f"""WITH {_PX}, f AS (SELECT id, v >= 0.1 AS a, v <= 0.2 AS b, (id % 3 <> 0) AS there FROM px), c AS (SELECT id, there, count(*) FILTER (a OR b) AS u, count(*) FILTER (a AND b) AS i FROM f GROUP BY ALL)
SELECT id, CASE WHEN there AND u > 0 THEN u END AS united, CASE WHEN there AND i > 0 THEN i END AS shared FROM c"""
)
def combined_masks(spark, sf_dir):
    """Sizes of the union and the intersection of two masks; images that lack one of them have neither."""
    rows = images(spark, sf_dir)
    mask = lambda test: F.transform("values", lambda v: test(v).cast("int"))
    masks = F.map_filter(F.create_map(F.lit("a"), mask(lambda v: v >= 0.1), F.lit("b"), mask(lambda v: v <= 0.2)), lambda k, v: (k == "a") | (F.col("id") % 3 != 0))
    rows = rows.withColumn("masks", masks)
    size = lambda how: F.size(F.filter(H.combined_mask(F.col("masks"), ["a", "b"], how), lambda v: v > 0)).cast("bigint")
    some = lambda how: F.when(H.combined_mask(F.col("masks"), ["a", "b"], how).isNotNull(), size(how))
    return rows.select("id", some("union").alias("united"), some("intersection").alias("shared"))
