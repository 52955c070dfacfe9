"""Queries that measure: ranking, overlap, calibration, gates, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import safe_number
from tesserae.operators import ladders as L
from tesserae.operators import metrics as M
from tesserae.operators import relational as R
from tesserae.operators import vector as V
from tesserae.operators.quantiles import exact_quantiles
from tesserae.plans import policies
from tesserae.plans.candidates import sql_finite
from tesserae.session import cut, table

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


_JUDGED = f"""
one AS (SELECT * FROM phase4_records QUALIFY row_number() OVER (PARTITION BY phase4_id ORDER BY ingested_at) = 1),
judged AS (SELECT phase4_id, provider, category, least(1.0e0, greatest(0.0e0, {sql_finite('generation_quality_score')})) AS score, len(quality_flags) = 0 AS truth FROM one WHERE quality_flags IS NOT NULL)
"""


def judged(spark, sf_dir):
    """Candidates with a score in [0, 1] and whether reviewers left them without a flag.

    Deliveries of one record have equal values, so they are made one on the
    few columns that come out.
    """
    rows = table(spark, sf_dir, "phase4_records").filter("phase4_id is not null")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), safe_number(F.col("generation_quality_score"))))
    rows = rows.filter("quality_flags is not null").select("phase4_id", "provider", "category", score.alias("score"), (F.size("quality_flags") == 0).alias("truth"))
    return rows.dropDuplicates(["phase4_id"])


_RANKED = """r AS (SELECT {g} score, truth, rank() OVER ({w} ORDER BY score) + (count(*) OVER (PARTITION BY {g} score) - 1) / 2.0e0 AS rk FROM judged)
SELECT {g} round((sum(CASE WHEN truth THEN rk END) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1) / 2.0e0) / nullif(count(*) FILTER (truth) * count(*) FILTER (NOT truth), 0), 6) AS auroc FROM r"""


@query(f"WITH {_JUDGED}, {_RANKED.format(g='', w='')}")
def auroc_ties(spark, sf_dir):
    """Chance that an unflagged candidate outranks a flagged one."""
    rungs = L.ladder(judged(spark, sf_dir), [], F.col("score"), F.col("truth"))
    return L.auroc(rungs, []).select(F.round("auroc", 6).alias("auroc"))


@query(f"WITH {_JUDGED}, {_RANKED.format(g='provider,', w='PARTITION BY provider')} GROUP BY provider")
def auroc_by_group(spark, sf_dir):
    """The same per provider."""
    rungs = L.ladder(judged(spark, sf_dir), ["provider"], F.col("score"), F.col("truth"))
    return L.auroc(rungs, ["provider"]).select("provider", F.round("auroc", 6).alias("auroc"))


@query(
    f"""WITH {_JUDGED}, s AS (SELECT score, count(*) FILTER (truth) AS p, count(*) AS n FROM judged GROUP BY 1),
c AS (SELECT score, p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM s)
SELECT round(sum(p * tp::DOUBLE / seen) / (SELECT count(*) FROM judged WHERE truth), 6) AS average_precision FROM c"""
)
def average_precision(spark, sf_dir):
    """Precision over the steps of recall."""
    rungs = L.ladder(judged(spark, sf_dir), [], F.col("score"), F.col("truth"))
    return L.average_precision(rungs, []).select(F.round("average_precision", 6).alias("average_precision"))


@query(
    f"""WITH {_JUDGED}, base AS (SELECT unnest([0.05e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS t
  UNION ALL SELECT unnest(quantile_cont(score, [i / 100.0e0 for i in range(1, 100)])) FROM judged
  UNION ALL SELECT min(score) - 1e-6 FROM judged UNION ALL SELECT max(score) + 1e-6 FROM judged),
t AS (SELECT DISTINCT round(greatest(0.0e0, least(1.0e0, t)), 6) AS threshold FROM base),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND truth) AS tp, count(*) FILTER (score >= threshold AND NOT truth) AS fp,
  count(*) FILTER (score < threshold AND truth) AS fn, count(*) FILTER (score < threshold AND NOT truth) AS tn FROM t, judged GROUP BY 1),
m AS (SELECT *, round((tp + fp) / greatest(1, tp + fp + fn + tn)::DOUBLE, 9) AS rate, round(2 * tp / greatest(1, 2 * tp + fp + fn)::DOUBLE, 9) AS dice FROM c),
o AS (SELECT *, round(dice - 0.25e0 * abs(rate - 0.3e0), 9) AS objective, rate BETWEEN 0.05 AND 0.95 AS satisfied FROM m)
SELECT threshold, round(rate, 6) AS rate, round(dice, 6) AS dice, round(objective, 6) AS objective, satisfied FROM o
ORDER BY satisfied DESC, o.objective DESC, o.dice DESC, round(abs(o.rate - 0.3e0), 9), threshold LIMIT 1"""
)
def threshold_search(spark, sf_dir):
    """The threshold with the best Dice less its distance from the target rate."""
    rows = cut(judged(spark, sf_dir))
    thresholds = M.threshold_candidates(rows, "score", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    best = M.best_threshold(M.threshold_sweep(rows, "score", "truth", thresholds), 0.25, 0.3, 0.05, 0.95)
    return best.select("threshold", F.round("rate", 6).alias("rate"), F.round("dice", 6).alias("dice"), F.round("objective", 6).alias("objective"), "satisfied")


_CELLS = "count(*) FILTER (score >= 0.5 AND truth) AS tp, count(*) FILTER (score >= 0.5 AND NOT truth) AS fp, count(*) FILTER (score < 0.5 AND truth) AS fn, count(*) FILTER (score < 0.5 AND NOT truth) AS tn"


@query(
    f"""WITH {_JUDGED}, c AS (SELECT provider, {_CELLS}, count(*) AS n FROM judged GROUP BY 1),
m AS (SELECT avg(tp / greatest(1, tp + fp + fn)::DOUBLE) AS i, avg(2 * tp / greatest(1, 2 * tp + fp + fn)::DOUBLE) AS d, round(avg((tp + fp) / greatest(1, n)::DOUBLE), 6) AS macro_positive_rate, round(avg((tp + fn) / greatest(1, n)::DOUBLE), 6) AS macro_truth_rate FROM c),
u AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c)
SELECT round(i, 6) AS macro_iou, round(d, 6) AS macro_dice, round(tp / greatest(1, tp + fp + fn)::DOUBLE, 6) AS micro_iou, round(2 * tp / greatest(1, 2 * tp + fp + fn)::DOUBLE, 6) AS micro_dice, macro_positive_rate, macro_truth_rate,
 (SELECT round(quantile_cont(score, 0.95), 6) FROM judged) AS score_p95 FROM m, u"""
)
def confusion_micro_macro(spark, sf_dir):
    """Overlap per provider averaged, and pooled."""
    rows = judged(spark, sf_dir)
    p95 = exact_quantiles(rows, [], "score", [0.95]).select(F.round(F.col("q")[0], 6).alias("score_p95"))
    cells = M.confusion(rows, ["provider"], F.col("score") >= 0.5, F.col("truth"))
    ratios = M.overlap_ratios()
    total = F.greatest(F.lit(1), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    macro = cells.agg(F.avg(ratios["iou"]).alias("i"), F.avg(ratios["dice"]).alias("d"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg((F.col("tp") + F.col("fp")) / total), 6).alias("macro_positive_rate"), F.round(F.avg((F.col("tp") + F.col("fn")) / total), 6).alias("macro_truth_rate"))
    both = macro.crossJoin(F.broadcast(p95))  # one row each
    return both.select(
        F.round("i", 6).alias("macro_iou"), F.round("d", 6).alias("macro_dice"), F.round(ratios["iou"], 6).alias("micro_iou"), F.round(ratios["dice"], 6).alias("micro_dice"), "macro_positive_rate", "macro_truth_rate", "score_p95"
    )


@query(
    f"""WITH {_JUDGED}, c AS (SELECT category, provider, {_CELLS} FROM judged WHERE category IS NOT NULL GROUP BY ALL)
SELECT category, provider, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE END, 6) AS iou, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END, 6) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END, 6) AS recall FROM c"""
)
def segmentation_by_group(spark, sf_dir):
    """Overlap per category and provider, null where nothing is there to compare."""
    cells = M.confusion(judged(spark, sf_dir).filter("category is not null"), ["category", "provider"], F.col("score") >= 0.5, F.col("truth"))
    r = M.overlap_ratios(guarded=False)
    return cells.select("category", "provider", *[F.round(r[x], 6).alias(x) for x in ("iou", "precision", "recall")])


_GENS = """one AS (SELECT * FROM generation_records QUALIFY row_number() OVER (PARTITION BY generation_id ORDER BY ingested_at) = 1),
lat AS (SELECT generation_id, model, latency_sec AS x FROM one WHERE latency_sec IS NOT NULL AND NOT isnan(latency_sec) AND NOT isinf(latency_sec) AND model IS NOT NULL),
med AS (SELECT model, median(x) AS med FROM lat GROUP BY 1),
stats AS (SELECT model, any_value(med) AS med, median(abs(x - med)) AS mad FROM lat JOIN med USING (model) GROUP BY 1)"""


def latencies(spark, sf_dir):
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "model", "latency_sec")
    return rows.filter("latency_sec is not null and not isnan(latency_sec) and abs(latency_sec) < double('infinity') and model is not null").withColumnRenamed("latency_sec", "x")


@query(f"WITH {_GENS} SELECT model, round(med, 6) AS med, round(mad, 6) AS mad FROM stats")
def robust_mad(spark, sf_dir):
    """Median and median absolute deviation of latency per model."""
    return M.robust_stats(latencies(spark, sf_dir), ["model"], "x").select("model", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query(
    f"WITH {_GENS} SELECT generation_id, round(1 / (1 + exp(-(greatest(-8.0e0, least(8.0e0, (x - med) / greatest(1e-6, 1.4826e0 * mad))) - 1.5e0))), 6) AS p FROM lat JOIN stats USING (model)"
)
def robust_probability(spark, sf_dir):
    """How unusual each latency is for its model."""
    rows = latencies(spark, sf_dir)
    stats = M.robust_stats(rows, ["model"], "x")
    return rows.join(stats, "model").select("generation_id", F.round(M.robust_probability(F.col("x"), F.col("med"), F.col("mad")), 6).alias("p"))


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.5) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN hi > lo THEN pow(least(1.0e0, greatest(0.0e0, (value - lo) / (hi - lo))), 2) ELSE 0.0e0 END, 6) AS calibrated FROM events JOIN q USING (event_type)"""
)
def quantile_calibration(spark, sf_dir):
    """Values between two quantiles of their type, squared."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    q = exact_quantiles(e, ["event_type"], "value", [0.5, 0.99]).select("event_type", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return e.join(q, "event_type").select("event_id", F.round(M.calibrated(F.col("value"), F.col("lo"), F.col("hi"), 2.0), 6).alias("calibrated"))


_P3 = [f"least(1 - 1e-5, greatest(1e-5, {x}))" for x in ("l_discount * 10", "l_tax * 12", "l_quantity / 50")]


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, {_P3[0]} AS a, {_P3[1]} AS b, {_P3[2]} AS c FROM lineitem),
f AS (SELECT *, 1 / (1 + exp(-((0.9e0*ln(a/(1-a)) + 0.6e0*ln(b/(1-b)) + 0.05e0*ln(c/(1-c))) / 1.55e0))) AS fused FROM p)
SELECT l_orderkey, l_linenumber, round(fused, 6) AS fused, round(least(1.0e0, 2*sqrt((0.9e0*(a-fused)*(a-fused) + 0.6e0*(b-fused)*(b-fused) + 0.05e0*(c-fused)*(c-fused)) / 1.55e0)), 6) AS disagreement FROM f"""
)
def logit_fusion(spark, sf_dir):
    """Three sources of evidence as one probability, with their disagreement."""
    li = table(spark, sf_dir, "lineitem")
    p = [F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50]
    fused, apart = M.fused_log_odds(p, [F.lit(0.9), F.lit(0.6), F.lit(0.0)])
    return li.select("l_orderkey", "l_linenumber", F.round(fused, 6).alias("fused"), F.round(apart, 6).alias("disagreement"))


@query(
    """WITH u AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v, user_id) AS i, count(*) OVER (PARTITION BY event_type) AS k FROM u)
SELECT event_type, round(avg(v), 6) AS macro, round(min(v), 6) AS worst, round(avg(v) FILTER (i <= greatest(1, k // 4)), 6) AS worst_quartile FROM n GROUP BY 1"""
)
def macro_worst_quartile(spark, sf_dir):
    """Mean over users, the worst user and the worst quarter, per event type."""
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    rows = M.worst_quartile(users, ["event_type"], "v")
    return rows.select("event_type", *[F.round(c, 6).alias(c) for c in ("macro", "worst", "worst_quartile")])


@query(
    f"""WITH {_JUDGED}, c AS (SELECT category, {_CELLS} FROM judged WHERE category IS NOT NULL GROUP BY 1),
d AS (SELECT 2 * tp / greatest(1, 2 * tp + fp + fn)::DOUBLE AS dice, tp / greatest(1, tp + fn)::DOUBLE AS recall FROM c),
m AS (SELECT round(avg(dice), 6) AS macro_dice, round(min(dice), 6) AS worst_dice, round(avg(recall), 6) AS recall FROM d),
a AS (SELECT unnest(settings.candidate_predictions) AS p FROM (SELECT * FROM auto_mask_records WHERE auto_mask_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY auto_mask_id ORDER BY ingested_at) = 1)),
v AS (SELECT round(avg((coalesce(p.disposition, 'needs_review') NOT IN ('needs_review', 'human_review', 'reject'))::INT), 6) AS coverage FROM a WHERE p IS NOT NULL),
r AS (SELECT round(avg(regret), 6) AS regret FROM ({policies.SQL['oracle_regret']}))
SELECT macro_dice, worst_dice, recall, coverage, regret, macro_dice >= 0.55 AND worst_dice >= 0.30 AND recall >= 0.90 AND coverage >= 0.75 AND regret <= 0.05 AS go FROM m, v, r"""
)
def go_no_go_gate(spark, sf_dir):
    """Whether macro and worst overlap, recall, accepted coverage and regret all clear their bars."""
    cells = M.confusion(judged(spark, sf_dir).filter("category is not null"), ["category"], F.col("score") >= 0.5, F.col("truth"))
    r = M.overlap_ratios()
    measures = cells.agg(F.round(F.avg(r["dice"]), 6).alias("macro_dice"), F.round(F.min(r["dice"]), 6).alias("worst_dice"), F.round(F.avg(r["recall"]), 6).alias("recall"))
    masks = R.once(table(spark, sf_dir, "auto_mask_records"), "auto_mask_id", "settings")
    said = masks.select(F.explode("settings.candidate_predictions").alias("p")).filter("p is not null").select(F.coalesce("p.disposition", F.lit("needs_review")).alias("d"))
    coverage = said.agg(F.round(F.avg((~F.col("d").isin("needs_review", "human_review", "reject")).cast("int")), 6).alias("coverage"))
    regret = policies.oracle_regret(spark, sf_dir).agg(F.round(F.avg("regret"), 6).alias("regret"))
    rows = measures.crossJoin(coverage).crossJoin(regret)  # one row each
    return M.gate(rows)


@query()
def bootstrap_ci(spark, sf_dir):
    """Interval of the mean of type means, groups and rows redrawn."""
    return M.bootstrap_interval(table(spark, sf_dir, "events").select("event_type", "value", "event_id"), "event_type", "value", "event_id")


@query(f"WITH {_JUDGED} SELECT round(quantile_cont(greatest(0.0e0, score - truth::INT), 0.9), 6) AS residual FROM judged")
def conformal_residual(spark, sf_dir):
    """How far scores overshoot what reviewers said, at the 90 % level."""
    rows = judged(spark, sf_dir).withColumn("actual", F.col("truth").cast("double"))
    return M.conformal_bound(rows, "score", "actual").select(F.round("residual", 6).alias("residual"))


@query()
def isotonic_conformal(spark, sf_dir):
    """Scores calibrated on what reviewers said, and what they are at least at the 90 % level."""
    rows = judged(spark, sf_dir).withColumn("actual", F.col("truth").cast("double"))
    return M.calibrated_bound(rows, "score", "actual").select("phase4_id", F.round("calibrated", 6).alias("calibrated"), F.round("lower", 6).alias("lower"))


# --- neighbours ----------------------------------------------------------------------------------------------------

_VEC = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT * FROM e WHERE label <> 0), m AS (SELECT * FROM e WHERE label = 0)"""


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.filter("label <> 0"), e.filter("label = 0"), e


@query(f"WITH {_VEC} SELECT t.vec_id, round(min(1 - list_dot_product(t.v, m.v)), 5) AS distance FROM t, m GROUP BY 1")
def knn1_cosine(spark, sf_dir):
    """Distance of every vector to the nearest normal one, by cosine."""
    t, m, _ = _sides(spark, sf_dir)
    return V.nearest(t, m, 1).select(F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"))


@query(f"WITH {_VEC} SELECT t.vec_id, round(min(list_distance(t.v, m.v)), 5) AS distance FROM t, m GROUP BY 1")
def knn1_euclid(spark, sf_dir):
    """The same by Euclidean distance."""
    t, m, _ = _sides(spark, sf_dir)
    return V.nearest(t, m, 1, "euclid").select(F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"))


@query(
    f"""WITH {_VEC}, d AS (SELECT t.vec_id, list_distance(t.v, m.v) AS d FROM t, m), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS n FROM d)
SELECT vec_id, round(avg(d), 5) AS distance FROM r WHERE n <= 5 GROUP BY 1"""
)
def knn_mean(spark, sf_dir):
    """Mean distance to the five nearest normal vectors."""
    t, m, _ = _sides(spark, sf_dir)
    return V.nearest(t, m, 5, "euclid").groupBy(F.col("id").alias("vec_id")).agg(F.round(F.avg("distance"), 5).alias("distance"))


@query(
    f"""WITH {_VEC}, d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS n FROM d)
SELECT vec_id, round(avg(d), 5) AS density FROM r WHERE n <= 4 GROUP BY 1"""
)
def self_density(spark, sf_dir):
    """Mean distance to the four nearest other vectors."""
    _, _, e = _sides(spark, sf_dir)
    return V.nearest(e, e, 4, "euclid", not_itself=True).groupBy(F.col("id").alias("vec_id")).agg(F.round(F.avg("distance"), 5).alias("density"))


@query(
    f"""WITH {_VEC}, d AS (SELECT t.vec_id, round(list_distance(t.v, m.v), 9) AS d FROM t, m), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS n FROM d),
a AS (SELECT vec_id, avg(d) AS far FROM k WHERE n <= 5 GROUP BY 1),
s AS (SELECT x.vec_id, round(list_distance(x.v, y.v), 9) AS d FROM t x JOIN t y ON x.vec_id <> y.vec_id), sk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS n FROM s),
b AS (SELECT vec_id, avg(d) AS dense FROM sk WHERE n <= 4 GROUP BY 1), j AS (SELECT * FROM a JOIN b USING (vec_id)),
z AS (SELECT min(far) AS fl, max(far) AS fh, min(dense) AS dl, max(dense) AS dh FROM j)
SELECT vec_id, round((far - fl) / (fh - fl) * (0.78e0 + 0.22e0 * (1 - (dense - dl) / (dh - dl))), 5) AS score FROM j, z"""
)
def musc_score(spark, sf_dir):
    """Distance from the normal ones, weighted by how crowded the place is."""
    t, m, _ = _sides(spark, sf_dir)
    mean = lambda df, name: df.groupBy("id").agg(F.avg(F.round("distance", 9)).alias(name))
    both = cut(mean(V.nearest(t, m, 5, "euclid"), "far").join(mean(V.nearest(t, t, 4, "euclid", True), "dense"), "id"))
    span = both.agg(F.min("far").alias("fl"), F.max("far").alias("fh"), F.min("dense").alias("dl"), F.max("dense").alias("dh"))
    unit = lambda x, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
    score = unit("far", "fl", "fh") * (0.78 + 0.22 * (1 - unit("dense", "dl", "dh")))
    return both.crossJoin(F.broadcast(span)).select(F.col("id").alias("vec_id"), F.round(score, 5).alias("score"))  # one row


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM e a, e b WHERE a.label = 1 AND b.label = 2),
x AS (SELECT a, arg_max(b, s) AS b FROM p GROUP BY 1), y AS (SELECT b, arg_max(a, s) AS a FROM p GROUP BY 1) SELECT x.a, x.b FROM x JOIN y ON x.a = y.a AND x.b = y.b"""
)
def mutual_nn(spark, sf_dir):
    """Vectors of two labels that are each other's nearest."""
    _, _, e = _sides(spark, sf_dir)
    return V.mutual_nearest(e.filter("label = 1"), e.filter("label = 2"))
