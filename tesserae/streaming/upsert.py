"""Records that arrive in files, merged into a table of latest rows. An extension to the batch operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.relational import last_wins
from tesserae.sources.sinks import read_text, replace_text


def stream_upsert(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], ordinal: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Stream parquet files from ``source``; ``latest`` of ``target`` has the last row of every key.

    The target is laid out in ``buckets`` of keys. A batch writes the buckets
    it has keys of in a new place and then names them as current in one rename:
    a reader sees all of a batch or none, a batch that stops half way leaves
    what was there, and one that is run twice is taken once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = _state(session, target)
        if number <= state["batch"]:
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = batch.withColumn("bucket", bucket)
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = [f"{target}/data/{state['buckets'][b]}/bucket={b}" for b in touched if b in state["buckets"]]
        if old:
            new = session.read.schema(batch.schema).parquet(*old).withColumn("bucket", bucket).unionByName(new)
        version = f"batch={number}"
        last_wins(new, [*keys, "bucket"], ordinal).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/{version}")
        state = {"batch": number, "buckets": {**state["buckets"], **{b: version for b in touched}}}
        replace_text(session, f"{target}/CURRENT", json.dumps(state, sort_keys=True))

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state(spark: SparkSession, target: str) -> dict:
    text = read_text(spark, f"{target}/CURRENT", missing="")
    return json.loads(text) if text else {"batch": -1, "buckets": {}}


def latest(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The last row of every key as of the last whole batch."""
    paths = [f"{target}/data/{version}/bucket={b}" for b, version in sorted(_state(spark, target)["buckets"].items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per time window and kind; rows later than ``late`` are left out on a stream."""
    watched = events.withWatermark(time, late) if events.isStreaming else events
    counted = watched.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n_rows"), F.round(F.sum(value), 4).alias("total"))
    return counted.select(F.col("w.start").alias("start"), kind, "n_rows", "total")
