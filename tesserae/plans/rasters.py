"""Queries on rasters: the 64 numbers of an embedding read as an 8 x 8 image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tesserae.operators import kernels as K
from tesserae.operators import raster as G
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


def images(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: v.cast("double")).alias("values"))


_PX = """px AS (SELECT vec_id AS id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, i - 1 AS pos, embedding[i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) g(i))"""


def _frame(ids, **columns) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, **columns})


@query(
    f"WITH {_PX} SELECT id, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1))::DOUBLE, 6) AS fill FROM px WHERE v >= 0.1 GROUP BY id"
)
def raster_stats(spark, sf_dir):
    """Area, box and fill of the bright cells."""

    def run(ids, s):
        m = s >= 0.1
        n, h, w = m.shape
        ys, xs = m.any(axis=2), m.any(axis=1)
        x1, y1, x2, y2 = xs.argmax(1), ys.argmax(1), w - xs[:, ::-1].argmax(1), h - ys[:, ::-1].argmax(1)
        area = m.sum(axis=(1, 2))
        out = _frame(ids, area=area, x1=x1, y1=y1, x2=x2, y2=y2, fill=np.round(area / ((x2 - x1) * (y2 - y1)), 6))
        return out[area > 0]

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, area bigint, x1 int, y1 int, x2 int, y2 int, fill double")


@query(
    f"""WITH {_PX}, m AS (SELECT id, covar_pop(x, y) AS c, var_pop(x) AS a, var_pop(y) AS b, count(*) AS n FROM px WHERE v >= 0.1 GROUP BY id)
SELECT id, round(cos(atan2(2*c, a - b)), 5) + 0.0e0 AS cos2, round(sin(atan2(2*c, a - b)), 5) + 0.0e0 AS sin2 FROM m WHERE n >= 3 AND abs(c) + abs(a - b) > 1e-9"""
)
def principal_axis(spark, sf_dir):
    """Direction of the bright cells, as the double angle, which has no sign to choose."""
    long = G.cells(images(spark, sf_dir)).filter("v >= 0.1")
    m = long.groupBy("id").agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.count("*").alias("n"))
    angle = F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))
    return m.filter("n >= 3 and abs(c) + abs(a - b) > 1e-9").select("id", (F.round(F.cos(angle), 5) + 0.0).alias("cos2"), (F.round(F.sin(angle), 5) + 0.0).alias("sin2"))


@query(
    f"""WITH {_PX}, g AS (SELECT a.id, (r.v - l.v) / 2 AS gx, (d.v - u.v) / 2 AS gy FROM px a JOIN px l ON l.id = a.id AND l.y = a.y AND l.x = a.x - 1 JOIN px r ON r.id = a.id AND r.y = a.y AND r.x = a.x + 1
  JOIN px u ON u.id = a.id AND u.x = a.x AND u.y = a.y - 1 JOIN px d ON d.id = a.id AND d.x = a.x AND d.y = a.y + 1),
t AS (SELECT id, sum(sqrt(gx*gx + gy*gy) * sin(2*atan2(gy, gx))) AS s, sum(sqrt(gx*gx + gy*gy) * cos(2*atan2(gy, gx))) AS c FROM g GROUP BY id)
SELECT id, round(degrees(0.5 * atan2(s, c)), 4) AS angle FROM t"""
)
def grain_angle(spark, sf_dir):
    """Strength-weighted mean direction of brightness changes."""

    def run(ids, s):
        gy, gx = (g[:, 1:-1, 1:-1] for g in K.gradients(s))
        strength, turn = np.hypot(gx, gy), 2 * np.arctan2(gy, gx)
        angle = 0.5 * np.degrees(np.arctan2((strength * np.sin(turn)).sum((1, 2)), (strength * np.cos(turn)).sum((1, 2))))
        return _frame(ids, angle=np.round(angle, 4))

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, angle double")


@query(
    f"""WITH {_PX}, m AS (SELECT id, x, y FROM px WHERE v >= 0.15),
d AS (SELECT DISTINCT m.id, m.x + a AS x, m.y + b AS y FROM m, generate_series(-1, 1) g(a), generate_series(-1, 1) k(b) WHERE m.x + a BETWEEN 0 AND 7 AND m.y + b BETWEEN 0 AND 7),
c AS (SELECT d.id, d.x, d.y FROM d JOIN generate_series(-1, 1) g(a) ON d.x + a BETWEEN 0 AND 7 JOIN generate_series(-1, 1) k(b) ON d.y + b BETWEEN 0 AND 7
  LEFT JOIN d n ON n.id = d.id AND n.x = d.x + a AND n.y = d.y + b GROUP BY ALL HAVING count(*) = count(n.id))
SELECT i.id, coalesce(dn, 0) AS dilated, coalesce(cn, 0) AS closed FROM (SELECT DISTINCT id FROM px) i LEFT JOIN (SELECT id, count(*) AS dn FROM d GROUP BY 1) USING (id) LEFT JOIN (SELECT id, count(*) AS cn FROM c GROUP BY 1) USING (id)"""
)
def dilate_close(spark, sf_dir):
    """Cells after dilation and after closing."""

    def run(ids, s):
        m = s >= 0.15
        return _frame(ids, dilated=K.dilate(m, 3).sum((1, 2)), closed=K.close(m, 3).sum((1, 2)))

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, dilated bigint, closed bigint")


_VOTE = f"""{_PX}, vote AS (SELECT id, pos, ((v >= 0.05)::INT + (v >= 0.1)::INT + (v >= 0.2)::INT) / 3.0e0 AS f FROM px)"""


def _votes(spark, sf_dir):
    df = images(spark, sf_dir)
    above = lambda t: F.transform("values", lambda v: F.when(v >= t, 1).otherwise(0))
    masks = [above(t) for t in (0.05, 0.1, 0.2)]
    return df.select("id", G.vote_fraction(masks).alias("vote"))


@query(
    f"""WITH {_VOTE} SELECT id, count(*) FILTER (f >= 0.67) AS core, count(*) FILTER (f >= 0.34 AND f < 0.67) AS possible,
  round(coalesce(avg(-(f*log2(f + 1e-6) + (1-f)*log2(1-f + 1e-6))) FILTER (f > 0 AND f < 1), 0), 6) AS entropy FROM vote GROUP BY id"""
)
def vote_consensus(spark, sf_dir):
    """Cells most and some masks agree on, and how unsure the votes are; all inside the row."""
    rows = _votes(spark, sf_dir).withColumn("level", G.soft_level(F.col("vote")))
    count = lambda n: F.size(F.filter("level", lambda v: v == n)).cast("bigint")
    return rows.select("id", count(255).alias("core"), count(128).alias("possible"), F.round(G.soft_entropy(F.col("vote")), 6).alias("entropy"))


@query(
    f"""WITH {_PX}, k AS (SELECT *, v >= 0.05 AS a, abs(v) >= 0.1 AS b FROM px)
SELECT id, count(*) FILTER (a OR b) AS both_any, count(*) FILTER (a AND b) AS both_all, count(*) FILTER (a AND NOT b) AS only_a FROM k GROUP BY id"""
)
def mask_setops(spark, sf_dir):
    """Union, intersection and difference of two masks, as sets of positions in the row."""
    at = lambda cond: F.filter(F.transform("values", lambda v, i: F.when(cond(v), i)), lambda p: p.isNotNull())
    rows = images(spark, sf_dir).select("id", at(lambda v: v >= 0.05).alias("a"), at(lambda v: F.abs(v) >= 0.1).alias("b"))
    n = lambda c: F.size(c).cast("bigint")
    return rows.select("id", n(F.array_union("a", "b")).alias("both_any"), n(F.array_intersect("a", "b")).alias("both_all"), n(F.array_except("a", "b")).alias("only_a"))


_PEAK = f"""{_PX}, p AS (SELECT id, x AS px, y AS py FROM px QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, pos) = 1)"""


@query(f"WITH {_PEAK} SELECT id, count(*) AS cells, round(sum(v), 6) AS total FROM px JOIN p USING (id) WHERE x >= px - 2 AND x < px + 3 AND y >= py - 2 AND y < py + 3 GROUP BY id")
def box_fence(spark, sf_dir):
    """What lies inside the box around the brightest cell."""

    def run(ids, s):
        n, h, w = s.shape
        top = s.reshape(n, -1).argmax(1)
        dy, dx = np.arange(h)[None, :, None] - (top // w)[:, None, None], np.arange(w)[None, None, :] - (top % w)[:, None, None]
        inside = (np.abs(dy) <= 2) & (np.abs(dx) <= 2)
        return _frame(ids, cells=inside.sum((1, 2)), total=np.round((s * inside).sum((1, 2)), 6))

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, cells bigint, total double")


@query(
    f"""WITH {_PEAK} SELECT id, round(sum(v * CASE WHEN abs(x - px) <= 1 AND abs(y - py) <= 1 THEN 1.0e0 WHEN abs(x - px) <= 2 AND abs(y - py) <= 2 THEN 0.5e0 ELSE 0.2e0 END), 6) AS weighted FROM px JOIN p USING (id) GROUP BY id"""
)
def spatial_prior(spark, sf_dir):
    """Brightness weighted by whether it lies in the box, at its margin or outside."""

    def run(ids, s):
        n, h, w = s.shape
        top = s.reshape(n, -1).argmax(1)
        far = np.maximum(np.abs(np.arange(h)[None, :, None] - (top // w)[:, None, None]), np.abs(np.arange(w)[None, None, :] - (top % w)[:, None, None]))
        return _frame(ids, weighted=np.round((s * np.where(far <= 1, 1.0, np.where(far <= 2, 0.5, 0.2))).sum((1, 2)), 6))

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, weighted double")


@query(f"WITH {_PX}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, pos) AS n FROM px) SELECT id, n::INT AS nth, pos::INT AS pos FROM r WHERE n <= 6")
def topk_pixels(spark, sf_dir):
    """The six brightest cells of each image, earlier ones first on ties."""

    def run(ids, s):
        order = np.argsort(-s.reshape(len(s), -1), axis=1, kind="stable")[:, :6]
        return _frame(np.repeat(ids, 6), nth=np.tile(np.arange(1, 7), len(ids)), pos=order.ravel())

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, nth int, pos int")


def _components_sql(eight: bool) -> str:
    near = "abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1" if eight else "abs(m.x - r.x) + abs(m.y - r.y) = 1"
    return f"""WITH RECURSIVE {_PX}, m AS (SELECT id, x, y, pos FROM px WHERE v >= 0.1),
r AS (SELECT id, x, y, pos AS label FROM m UNION SELECT m.id, m.x, m.y, r.label FROM r JOIN m ON m.id = r.id AND {near}),
c AS (SELECT id, x, y, min(label) AS label FROM r GROUP BY ALL)
SELECT id, label::INT AS label, count(*) AS area FROM c GROUP BY ALL"""


def _component_rows(ids, s, eight):
    label = K.components(s >= 0.1, eight)
    i, at = np.nonzero(label.reshape(len(s), -1) >= 0)
    rows = pd.DataFrame({"id": ids[i], "label": label.reshape(len(s), -1)[i, at]})
    return rows.groupby(["id", "label"], as_index=False).size().rename(columns={"size": "area"})


@query(_components_sql(False))
def components4(spark, sf_dir):
    """Connected bright areas by shared sides."""
    return G.map_rasters(images(spark, sf_dir), lambda ids, s: _component_rows(ids, s, False), "id bigint, label int, area bigint")


@query(_components_sql(True))
def components8(spark, sf_dir):
    """Connected bright areas by shared sides or corners."""
    return G.map_rasters(images(spark, sf_dir), lambda ids, s: _component_rows(ids, s, True), "id bigint, label int, area bigint")


@query(
    _components_sql(False).split("SELECT id, label::INT")[0]
    + """, a AS (SELECT id, label, count(*) AS area FROM c GROUP BY ALL),
b AS (SELECT *, coalesce(sum(area) OVER (PARTITION BY id ORDER BY area DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM a)
SELECT id, count(*) AS kept, sum(area)::BIGINT AS area FROM b WHERE used < 10 GROUP BY id"""
)
def area_budget(spark, sf_dir):
    """Components by size until ten cells are used; the last one may overshoot."""

    def run(ids, s):
        rows = _component_rows(ids, s, False).sort_values(["id", "area", "label"], ascending=[True, False, True])
        before = rows.groupby("id")["area"].cumsum() - rows["area"]
        return rows[before < 10].groupby("id", as_index=False).agg(kept=("area", "size"), area=("area", "sum"))

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, kept bigint, area bigint")


@query(
    f"""WITH {_PX}, n AS (SELECT p.id, p.pos, CASE WHEN p.x + a < 0 THEN 1 WHEN p.x + a > 7 THEN 6 ELSE p.x + a END AS x, CASE WHEN p.y + b < 0 THEN 1 WHEN p.y + b > 7 THEN 6 ELSE p.y + b END AS y
  FROM px p, generate_series(-1, 1) g(a), generate_series(-1, 1) k(b)),
s AS (SELECT n.id, n.pos, avg(q.v) AS v FROM n JOIN px q ON q.id = n.id AND q.x = n.x AND q.y = n.y GROUP BY ALL)
SELECT id, round(max(v), 6) AS highest, round(min(v), 6) AS lowest, round(sum(v), 6) AS total FROM s GROUP BY id"""
)
def box_blur(spark, sf_dir):
    """Extremes and sum after a 3 x 3 mean, reflected at the border."""

    def run(ids, s):
        b = K.box_blur(s, 1)
        return _frame(ids, highest=np.round(b.max((1, 2)), 6), lowest=np.round(b.min((1, 2)), 6), total=np.round(b.sum((1, 2)), 6))

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, highest double, lowest double, total double")


@query(
    f"""WITH {_PX}, g AS (SELECT a.id, coalesce(r.v, a.v) - coalesce(l.v, a.v) AS dx, CASE WHEN l.v IS NULL OR r.v IS NULL THEN 1 ELSE 2 END AS n FROM px a
  LEFT JOIN px l ON l.id = a.id AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN px r ON r.id = a.id AND r.y = a.y AND r.x = a.x + 1)
SELECT id, round(sum(abs(dx / n)), 6) AS total_x FROM g GROUP BY id"""
)
def gradients(spark, sf_dir):
    """Total change along rows, central inside and one-sided at the border."""
    return G.map_rasters(images(spark, sf_dir), lambda ids, s: _frame(ids, total_x=np.round(np.abs(K.gradients(s)[1]).sum((1, 2)), 6)), "id bigint, total_x double")


@query()
def aupro(spark, sf_dir):
    """Overlap per component against false positives; truth is the brightest tenth, the score a blurred image."""

    def run(ids, s):
        truth = s >= np.quantile(s, 0.9, axis=(1, 2), keepdims=True)
        return _frame(ids, aupro=np.round(K.aupro(K.normalised(K.box_blur(s)), truth), 6))

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, aupro double")


@query()
def fft_notch(spark, sf_dir):
    """Images without their regular texture."""
    return G.map_rasters(images(spark, sf_dir), lambda ids, s: G.arrays(ids, np.round(K.fft_notch(s), 6)), "id bigint, values array<double>")


@query()
def structure_tensor(spark, sf_dir):
    """Ridge maps."""
    return G.map_rasters(images(spark, sf_dir), lambda ids, s: G.arrays(ids, np.round(K.structure_ridge(s), 6)), "id bigint, values array<double>")


@query()
def patch_features(spark, sf_dir):
    """Seven numbers for every patch of the grid."""

    def run(ids, s):
        f = K.patch_features(s)
        n, p, _ = f.shape
        return pd.DataFrame({"id": np.repeat(ids, p), "patch": np.tile(np.arange(p), n), "features": list(np.round(f, 6).reshape(n * p, -1))})

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, patch int, features array<double>")


@query()
def generic_proposals(spark, sf_dir):
    """Per image and quantile threshold the whole mask and its four largest areas, each mask once, with their measurements.

    An 8 x 8 raster has areas of few cells, so none is too small.
    """
    names = ("evidence_coverage", "normal_contrast", "component_count", "area_fraction", "compactness", "elongation", "boundary_contact", "periodicity_disruption")

    def run(ids, s):
        rows = [(i, mode, int(mask.sum()), *(round(m[n], 6) for n in names)) for i, image in zip(ids, s) for mode, mask, m in K.generic_proposals(image, min_area=1)]
        return pd.DataFrame(rows, columns=["id", "mode", "area", *names])

    return G.map_rasters(images(spark, sf_dir), run, "id bigint, mode string, area bigint, " + ", ".join(f"{n} double" for n in names))


@query()
def greedy_nms(spark, sf_dir):
    """Per user the strongest events that keep an hour's distance, at most five, numbered by time."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id", ignore_index=True)
        kept = K.greedy_windows(rows["value"].to_numpy(), rows["at"].to_numpy() / 3.6e9, 1.0, 5)
        return rows.iloc[kept][["user_id", "event_id"]].assign(nth=np.arange(1, len(kept) + 1))

    return e.groupBy("user_id").applyInPandas(run, "user_id bigint, event_id bigint, nth int")
