"""Writing results: append, seal once, publish several tables as one."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """One CSV file with a header and the fields in this order; for reports, not for tables."""
    df.select(*fields).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def seal(df: DataFrame, path: str) -> None:
    """Write once: a second evaluation of a sealed result is refused."""
    df.write.mode("errorifexists").parquet(path)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], checks: dict[str, str] | None = None) -> str:
    """Write tables into a new run directory and make it current in one rename.

    ``checks``: table -> SQL condition all its rows must meet. If a table fails
    to write or to meet its check, the current run stays as it was and the
    failed one is left in place with its status. Returns the run's name.
    """
    run = f"{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    where = f"{root}/runs/{run}"
    status, error = "started", ""
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{where}/{name}")
        for name, condition in (checks or {}).items():
            bad = spark.read.parquet(f"{where}/{name}").filter(f"NOT coalesce(({condition}), false)")
            if not bad.isEmpty():
                raise ValueError(f"{name} has rows that do not meet: {condition}")
        status = "succeeded"
    except Exception as e:
        status, error = "failed", str(e)[:2000]
        raise
    finally:
        _write_text(spark, f"{where}/_status.json", json.dumps({"run": run, "status": status, "error": error, "tables": sorted(tables)}, sort_keys=True))
    replace_text(spark, f"{root}/CURRENT", run)
    return run


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written beside its place and put there in one rename, so that readers see the old or the new one; writers do not share a name."""
    beside = f"{path}.{uuid.uuid4().hex}"
    _write_text(spark, beside, text)
    _, new = _fs(spark, beside)
    _, now = _fs(spark, path)
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(options, 1)
    modes[0] = options.OVERWRITE
    context.rename(context.makeQualified(new), context.makeQualified(now), modes)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A value as JSON with sorted keys, two spaces deep, in one rename."""
    replace_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def markdown_table(df: DataFrame, title: str, most: int = 200) -> str:
    """The first ``most`` rows of a report as a Markdown table; a report, not a table of records, so a limit belongs to it."""
    rows = df.limit(most + 1).collect()
    say = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(say(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + (["", f"More than {most} rows."] if len(rows) > most else [])) + "\n"


def write_report(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """A Markdown report with one table per title, in one rename."""
    replace_text(spark, path, "\n".join(markdown_table(df, title) for title, df in tables.items()))


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the run that is current."""
    return spark.read.parquet(f"{root}/runs/{read_text(spark, f'{root}/CURRENT')}/{name}")


def copy_changed(spark: SparkSession, source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, sha256) of files the target does not have with this content."""
    return source.join(target.select("path", "sha256"), ["path", "sha256"], "left_anti").select("path", "sha256")


def run_log_row(spark: SparkSession, run: str, status: str, **facts: str) -> DataFrame:
    """A row for the run log: started, succeeded, failed or interrupted."""
    if status not in ("started", "succeeded", "failed", "interrupted"):
        raise ValueError(f"unknown status {status}")
    row = spark.createDataFrame([(run, status, json.dumps(facts, sort_keys=True))], "run string, status string, facts string")
    return row.withColumn("at", F.current_timestamp())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str, missing: str | None = None) -> str:
    """A small file's text; ``missing`` where there is none, an error if that is not given."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        if missing is None:
            raise FileNotFoundError(path)
        return missing
    return spark.read.text(path, wholetext=True).first()[0].strip()
