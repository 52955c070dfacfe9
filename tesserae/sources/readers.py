"""Reading records, reports and file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def strict_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines of exactly this schema; a damaged line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and damaged ones and those that are no object are left out.

    Lines are read as text and parsed, so the choice of columns later on can
    not change which lines count as damaged.
    """
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    whole = lines.filter(F.col("line").startswith("{") & F.col("line").endswith("}") & F.expr("try_parse_json(line) is not null"))
    return whole.select(F.from_json("line", shape).alias("r")).filter("r is not null").select("r.*")


def manifest_rows(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of manifests that are JSON lines, one JSON list, or one object with ``rows``."""
    shape = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).simpleString()
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    kind = F.when(F.col("t").startswith("["), "list").when(F.expr("try_variant_get(try_parse_json(concat('[', t, ']')), '$[0].rows') is not null"), "rows").otherwise("lines")
    kinds = whole.withColumn("kind", kind)
    listed = kinds.filter("kind <> 'lines'").select(
        F.when(F.col("kind") == "list", F.from_json("t", f"array<{shape}>")).otherwise(F.from_json("t", f"struct<rows: array<{shape}>>")["rows"]).alias("rows")
    )
    lines = kinds.filter("kind = 'lines'").select(F.explode(F.split("t", r"\r?\n")).alias("line"))
    lines = lines.filter(F.trim("line").startswith("{")).select(F.from_json("line", shape).alias("r"))
    return listed.select(F.explode("rows").alias("r")).unionByName(lines).filter("r is not null").select("r.*")


def metric_csv(spark: SparkSession, path: str | list[str], key: str, numbers: list[str]) -> DataFrame:
    """CSV with a header as (key, numbers...); what is no number is null, the last row of a key counts."""
    rows = spark.read.option("header", True).csv(path)
    typed = rows.select(key, F.monotonically_increasing_id().alias("__o"), *[F.col(n).try_cast("double").alias(n) for n in numbers])
    best = typed.groupBy(key).agg(F.max_by(F.struct(*numbers), "__o").alias("r"))
    return best.select(key, "r.*")


def file_inventory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, hashes: bool = False) -> DataFrame:
    """(path, length, modified[, sha256]) of all files below ``path`` with one of the suffixes in any case.

    Contents are read only when hashes are asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    columns = ["path", "length", F.col("modificationTime").alias("modified")]
    return wanted.select(*columns, *([F.sha2("content", 256).alias("sha256")] if hashes else []))


def defect_images(spark: SparkSession, root: str, targets: list[tuple[str, str]], most: int = 0, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(category, defect_type, path) of the images below ``root/category/test/defect_type``, by path, at most ``most`` per target.

    A target without any image is an error.
    """
    files = file_inventory(spark, root, suffixes).withColumn("p", F.regexp_extract("path", r"([^/]+)/test/([^/]+)/.+$", 0))
    files = files.select("path", F.regexp_extract("path", r"([^/]+)/test/([^/]+)/.+$", 1).alias("category"), F.regexp_extract("path", r"([^/]+)/test/([^/]+)/.+$", 2).alias("defect_type"))
    wanted = F.broadcast(spark.createDataFrame(targets, "category string, defect_type string"))
    rows = files.join(wanted, ["category", "defect_type"])
    found = {(r[0], r[1]) for r in rows.select("category", "defect_type").distinct().collect()}  # at most one row per target
    missing = sorted(set(targets) - found)
    if missing:
        raise FileNotFoundError(f"no images for {'/'.join(missing[0])}")
    if most > 0:
        order = Window.partitionBy("category", "defect_type").orderBy("path")
        rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")
    return rows.select("category", "defect_type", "path").orderBy("category", "defect_type", "path")


def newest_union(spark: SparkSession, combined: str, parts: list[str], schema: T.StructType | str) -> DataFrame:
    """The combined file if there is one, else all parts, each row with the file it came from."""
    jvm = spark._jvm
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(p))
    paths = [combined] if there(combined) else [p for p in parts if there(p)]
    if not paths:
        raise FileNotFoundError(f"neither {combined} nor any of {len(parts)} parts exists")
    return spark.read.schema(schema).json(paths).withColumn("file", F.input_file_name())
