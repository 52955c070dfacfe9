"""Queries on manifests, lineage and reports, and the batch form of the windowed stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import finite
from tesserae.operators import lineage as N
from tesserae.operators import relational as R
from tesserae.operators.orphans import TABLES, links
from tesserae.plans.candidates import sql_finite
from tesserae.plans.drift_and_lineage import _NAMED
from tesserae.session import table
from tesserae.streaming.upsert import windowed_counts

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


_SAMPLES = "s AS (SELECT sample_id, any_value(category) AS category, any_value(defect_type) AS defect_type, any_value(image_path) AS image_path, any_value(split) AS split, any_value(eval_mask_path) AS eval_mask_path, any_value(training_mask_path) AS training_mask_path, any_value(uncertainty_mask_path) AS uncertainty_mask_path FROM anomaly_samples GROUP BY 1)"


def samples(spark, sf_dir):
    cols = ["category", "defect_type", "image_path", "split", "eval_mask_path", "training_mask_path", "uncertainty_mask_path"]
    return R.once(table(spark, sf_dir, "anomaly_samples"), "sample_id", *cols)


@query(
    f"""WITH {_SAMPLES} SELECT category || '/' || defect_type AS target, split, (row_number() OVER (PARTITION BY category, defect_type, split ORDER BY sample_id) - 1)::INT AS place, sample_id, image_path FROM s
WHERE split IN ('adaptation', 'held_out') AND category IS NOT NULL AND defect_type IS NOT NULL QUALIFY split = 'adaptation' OR place < 20"""
)
def manifest_flatten(spark, sf_dir):
    """Samples of nested manifests: all of the adaptation split, at most twenty held out per target."""
    rows = samples(spark, sf_dir).filter("split in ('adaptation', 'held_out') and category is not null and defect_type is not null")
    nested = N.manifest(rows, ["category", "defect_type"], "split", ["image_path"], "sample_id")
    return N.manifest_samples(nested, 20)


@query(
    f"""WITH {_SAMPLES}, a AS (SELECT DISTINCT category, image_path FROM s WHERE split = 'adaptation'), b AS (SELECT DISTINCT category, image_path FROM s WHERE split = 'locked')
SELECT category, image_path FROM a WHERE image_path IS NOT NULL AND category IS NOT NULL INTERSECT SELECT category, image_path FROM b"""
)
def split_disjointness(spark, sf_dir):
    """Images that stand in the adaptation and the locked set."""
    rows = samples(spark, sf_dir).select("category", "image_path", "split").filter("image_path is not null and category is not null")
    return N.shared_keys(rows.filter("split = 'adaptation'"), rows.filter("split = 'locked'"), ["category", "image_path"])


@query(
    f"""WITH {_SAMPLES} SELECT DISTINCT category FROM s WHERE split = 'locked' AND category IS NOT NULL EXCEPT SELECT category FROM s WHERE split = 'adaptation'"""
)
def unassigned_categories(spark, sf_dir):
    """Spellings of categories that are evaluated but never adapted to."""
    rows = samples(spark, sf_dir).filter("category is not null")
    return N.unassigned(rows.filter("split = 'locked'"), rows.filter("split = 'adaptation'"), ["category"])


@query(
    f"""WITH {_SAMPLES} SELECT k.split, count(s.sample_id) AS n_rows FROM (VALUES ('adaptation'), ('held_out'), ('locked'), ('retired')) k(split) LEFT JOIN s USING (split) GROUP BY 1"""
)
def zero_filled_counts(spark, sf_dir):
    """Samples per known split, 0 for one without any."""
    return N.counts_for(samples(spark, sf_dir), "split", ["adaptation", "held_out", "locked", "retired"])


_ROLE = "CASE WHEN contains(p, '/eval') THEN 'evaluation' WHEN contains(p, 'unc') THEN 'uncertainty' WHEN contains(p, 'train') THEN 'training' WHEN contains(p, 'soft') THEN 'training' WHEN contains(p, 'ground_truth') THEN 'truth' WHEN contains(p, 'refined') THEN 'refined' WHEN p = '' THEN 'none' ELSE 'other' END"


@query(
    f"""WITH {_SAMPLES}, u AS (SELECT sample_id, 'evaluation' AS expected, eval_mask_path AS path FROM s UNION ALL SELECT sample_id, 'training', training_mask_path FROM s UNION ALL SELECT sample_id, 'uncertainty', uncertainty_mask_path FROM s),
r AS (SELECT *, lower(coalesce(path, '')) AS p FROM u), o AS (SELECT expected, {_ROLE} AS observed FROM r)
SELECT expected, observed, expected = observed AS agrees, count(*) AS n_rows FROM o GROUP BY ALL"""
)
def mask_policy_check(spark, sf_dir):
    """One row per expected and observed role of the masks."""
    rows = samples(spark, sf_dir)
    long = rows.select("sample_id", F.expr("stack(3, 'evaluation', eval_mask_path, 'training', training_mask_path, 'uncertainty', uncertainty_mask_path) as (expected, path)"))
    seen = long.select("expected", N.mask_role(F.col("path")).alias("observed"))
    return seen.groupBy("expected", "observed", (F.col("expected") == F.col("observed")).alias("agrees")).agg(F.count("*").alias("n_rows"))


@query(
    f"""WITH {_NAMED}, k AS (SELECT DISTINCT rel_path FROM artifact_inventory)
SELECT table_name, field_name, count(*) AS n_refs, count(k.rel_path) AS n_known, count(*) - count(k.rel_path) AS n_unknown FROM resolved r LEFT JOIN k ON k.rel_path = r.path GROUP BY ALL"""
)
def path_exists_audit(spark, sf_dir):
    """References per table and field, and how many name a file that ever was."""
    refs = None
    for t in TABLES:
        df = table(spark, sf_dir, t.name).dropDuplicates([t.id_column])
        part = links(df, t, t.references).select("table_name", "field_name", "key")
        refs = part if refs is None else refs.unionByName(part)
    return N.exists_audit(refs, table(spark, sf_dir, "artifact_inventory"))


_FIN = sql_finite("latency_sec", "NULL")


@query(
    f"""WITH g AS (SELECT generation_id, any_value(model) AS model, any_value(latency_sec) AS latency_sec, any_value(error) AS error FROM generation_records GROUP BY 1)
SELECT model, count(*) AS n_rows, round(avg({_FIN}), 6) AS mean_latency, round(max({_FIN}), 6) AS max_latency, count(error) AS n_errors FROM g GROUP BY 1"""
)
def latency_summary(spark, sf_dir):
    """Latency and errors per model; numbers that are none do not count."""
    rows = R.once(table(spark, sf_dir, "generation_records"), "generation_id", "model", "latency_sec", "error")
    x = finite(F.col("latency_sec"))
    return rows.groupBy("model").agg(
        F.count("*").alias("n_rows"), F.round(F.avg(x), 6).alias("mean_latency"), F.round(F.max(x), 6).alias("max_latency"), F.count("error").alias("n_errors")
    )


@query(
    """SELECT vec_id AS id, [round(greatest(0e0, least(1e0, (0.5e0 + embedding[i]::DOUBLE / 2) * 0.75e0 + (0.5e0 + embedding[i - 2 * ((i - 1) % 8) + 7]::DOUBLE / 2) * 0.25e0)), 6) FOR i IN generate_series(1, 64)] AS fused FROM embeddings"""
)
def zip_fuse_rasters(spark, sf_dir):
    """The scores of each 8 x 8 raster fused with those of its mirror image, every cell."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.lit(0.5) + v.cast("double") / 2).alias("score"))
    rows = rows.withColumn("mirrored", F.flatten(F.transform(F.sequence(F.lit(1), F.size("score"), F.lit(8)), lambda i: F.reverse(F.slice("score", i, F.lit(8))))))
    return N.fuse_scores(rows, "score", "mirrored", 0.25, "fused").select("id", F.transform("fused", lambda v: F.round(v, 6)).alias("fused"))


@query(
    "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n_rows, round(sum(value), 4) AS total FROM events GROUP BY ALL"
)
def windowed_events(spark, sf_dir):
    """Events per five minutes and type; the same plan runs on a stream."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value")
