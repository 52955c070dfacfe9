"""Queries that write records and read them again, through the readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators.lineage import guard
from tesserae.sources import readers, sinks
from tesserae.session import scratch, table

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


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def appended_json(spark, sf_dir):
    """Suppliers appended to JSON lines in two parts and read under their schema."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    where = scratch(spark, "records")
    sinks.append_records(rows, where)
    sinks.append_records(rows.filter("s_acctbal > 0"), where)
    return readers.strict_json(spark, where, rows.schema)


@query(
    """SELECT json_extract_string(payload, '$.category') AS category, json_extract_string(payload, '$.model') AS model, count(*) AS n_rows FROM raw_record_lines
WHERE record_type = 'generation' AND json_valid(trim(payload)) AND json_type(trim(payload)) = 'OBJECT' GROUP BY ALL"""
)
def lenient_lines(spark, sf_dir):
    """Written lines read again; damaged ones, blank ones and those that are no object are left out."""
    where = scratch(spark, "lines")
    lines = table(spark, sf_dir, "raw_record_lines").filter("record_type = 'generation' and payload is not null").select(F.translate("payload", "\r\n", "  ").alias("value"))
    lines.write.text(where)
    return readers.lenient_json(spark, where, "category string, model string").groupBy("category", "model").agg(F.count("*").alias("n_rows"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def manifest_forms(spark, sf_dir):
    """One manifest as JSON lines and one as an object with rows, read alike."""
    rows, where = table(spark, sf_dir, "region"), scratch(spark, "manifests")
    rows.coalesce(1).write.json(f"{where}/lines")
    other = rows.withColumn("r_regionkey", F.col("r_regionkey") + 100)
    other.agg(F.to_json(F.struct(F.collect_list(F.struct(*other.columns)).alias("rows"))).alias("value")).write.text(f"{where}/object")
    return readers.manifest_rows(spark, [f"{where}/lines", f"{where}/object"], "r_regionkey int, r_name string")


@query("SELECT n_name, max(n_regionkey)::DOUBLE AS n_regionkey, NULL::DOUBLE AS n_none FROM nation GROUP BY 1")
def metrics_by_key(spark, sf_dir):
    """A CSV report read by key; what is no number is null."""
    rows, where = table(spark, sf_dir, "nation"), scratch(spark, "report")
    sinks.report_csv(rows.withColumn("n_none", F.lit("n/a")), where, ["n_name", "n_regionkey", "n_none"])
    return readers.metric_csv(spark, where, "n_name", ["n_regionkey", "n_none"])


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def published_tables(spark, sf_dir):
    """Two tables published as one; a later run that breaks its check leaves them current."""
    rows, root = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), scratch(spark, "published")
    even = rows.filter("s_suppkey % 2 = 0")
    sinks.publish(spark, root, {"even": even, "all": rows}, {"even": "s_suppkey % 2 = 0"})
    try:
        sinks.publish(spark, root, {"even": rows, "all": rows}, {"even": "s_suppkey % 2 = 0"})
    except ValueError:
        return sinks.current(spark, root, "even")
    raise AssertionError("a run that breaks its check was published")


@query("SELECT 'sealed' AS first_write, true AS second_is_refused, count(*) AS n_rows FROM region")
def sealed_result(spark, sf_dir):
    """A result that is written once; a second write is refused."""
    rows, where = table(spark, sf_dir, "region"), scratch(spark, "sealed")
    sinks.seal(rows, where)
    try:
        sinks.seal(rows.limit(0), where)
        refused = False
    except Exception:  # noqa: BLE001 - whichever way the refusal comes
        refused = True
    return spark.read.parquet(where).agg(F.lit("sealed").alias("first_write"), F.lit(refused).alias("second_is_refused"), F.count("*").alias("n_rows"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN 'combined' ELSE 'none' END AS file FROM nation WHERE n_regionkey < 3")
def newest_file(spark, sf_dir):
    """The combined file where there is one, instead of its parts."""
    rows, where = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), scratch(spark, "parts")
    rows.filter("n_regionkey >= 2").write.json(f"{where}/part1")
    rows.filter("n_regionkey < 3").write.json(f"{where}/combined")
    found = readers.newest_union(spark, f"{where}/combined", [f"{where}/part1", f"{where}/part2"], rows.schema)
    return found.select("n_nationkey", F.regexp_extract("file", r"/(combined|part\d)/[^/]*$", 1).alias("file"))


@query("SELECT DISTINCT artifact_id, rel_path AS path FROM artifact_inventory WHERE rel_path IS NOT NULL AND NOT (kind = 'truth_mask')")
def changed_files(spark, sf_dir):
    """Files whose content the target does not have yet."""
    files = table(spark, sf_dir, "artifact_inventory").filter("rel_path is not null").select("artifact_id", "kind", F.col("rel_path").alias("path"), F.concat_ws(":", "artifact_id", "content_hash").alias("sha256")).distinct()
    wanted = sinks.copy_changed(spark, files, files.filter("kind = 'truth_mask'"))
    return wanted.select(F.substring_index("sha256", ":", 1).cast("bigint").alias("artifact_id"), "path").distinct()


@query("SELECT DISTINCT generation_id FROM generation_records WHERE generation_id IS NOT NULL")
def guarded_versions(spark, sf_dir):
    """Records of the version that is asked for; one of another would stop the query."""
    rows = table(spark, sf_dir, "generation_records").select("generation_id").filter("generation_id is not null").distinct().withColumn("version", F.lit(3))
    return guard(rows, F.col("version") != 3, "a record of another version").select("generation_id")
