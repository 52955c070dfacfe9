"""Did something exist at a time? A distributed running count per key.

Lives (start inclusive, end exclusive) and questions (key, time) are laid on
one time line per key. A key may hold a third of all rows on either side, so
the line is cut into days: one aggregation gives every (key, day) its net
change, a window over those few rows carries the count into each day, and the
running count itself is only taken within a day. A day of a key with more than
``HOT_QUESTIONS`` questions (a bulk load that names one file) is cut further:
its questions are spread over parts by hash, each with all changes of the day.
No pair of a question and a life is ever formed, so many lives per key cost no
more than few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import broadcast_if_small, cut

#: Questions about one key on one day up to which one task answers them.
HOT_QUESTIONS = 500_000


def live_events(lives: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, at, change): +1 when a life starts and -1 when it ends.

    A life without key or start, or one that ends no later than it starts,
    never was. An end of null means it lasts.
    """
    ok = F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    marks = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("change")),
        F.struct(F.col(end).alias("at"), F.lit(-1).alias("change")),
    )
    return (
        lives.filter(ok)
        .select(F.col(key).alias("key"), F.explode(marks).alias("m"))
        .select("key", "m.at", "m.change")
        .filter(F.col("at").isNotNull())
    )


#: Where questions without a time stand: after everything else.
_LAST = "9999-12-31 00:00:00"


def _bucket(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / seconds)


def _cell(key: Column, bucket: Column) -> Column:
    return F.xxhash64(key, bucket)


def _hot_cells(questions: DataFrame, seconds: int) -> DataFrame | None:
    """(cell, parts) of days of a key with too many questions for one task, counted; None if there are none.

    A cell is known by a hash; should two share one, both are cut, which changes no answer.
    """
    ending = F.coalesce("at", F.to_timestamp(F.lit(_LAST)).cast(questions.schema["at"].dataType))
    cells = questions.groupBy(_cell(F.col("key"), _bucket(ending, seconds)).alias("cell")).agg(F.count("*").alias("n"))
    cells = cut(cells.filter(F.col("n") > HOT_QUESTIONS).select("cell", F.ceil(F.col("n") / HOT_QUESTIONS).cast("int").alias("parts")))
    count = cells.count()
    return broadcast_if_small(cells, count) if count else None


def _in_parts(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` with ``part``: questions of a hot cell by hash, its changes in every part."""
    if hot is None:
        return rows.withColumn("part", F.lit(0))
    known = rows.withColumn("cell", _cell(F.col("key"), F.col("bucket"))).join(hot, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    return known.withColumn("part", F.explode(F.when(F.col("q").isNotNull(), own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("cell", "parts")


def alive_counts(questions: DataFrame, events: DataFrame, payload: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """``questions`` (key, at, *payload) with ``alive``: lives that hold at ``at``.

    Changes at the very moment of a question come before it. A question with
    a null time counts every life its key ever had, whenever that was.
    """
    bundle = F.struct(*payload)
    hot = _hot_cells(questions, bucket_seconds)
    ending = F.coalesce("at", F.to_timestamp(F.lit(_LAST)).cast(questions.schema["at"].dataType))
    asked = questions.select("key", ending.alias("at"), F.lit(0).alias("change"), F.struct(F.col("at").isNull().alias("ever"), bundle.alias("p")).alias("q"))
    nothing = F.lit(None).cast(asked.schema["q"].dataType)
    line = events.select("key", "at", "change", nothing.alias("q")).unionByName(asked)
    line = line.withColumn("born", F.when(F.col("change") > 0, F.col("change")).otherwise(0)).withColumn("bucket", _bucket(F.col("at"), bucket_seconds))

    per_bucket = line.groupBy("key", "bucket").agg(F.sum("change").alias("net"), F.sum("born").alias("births"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_bucket.withColumn("carry", F.coalesce(F.sum("net").over(before), F.lit(0)))
        .withColumn("born", F.coalesce(F.sum("births").over(before), F.lit(0)).cast("int"))
        .filter(F.col("born") != 0)
        .select("key", F.lit(None).cast(line.schema["at"].dataType).alias("at"), F.col("carry").cast("int").alias("change"), nothing.alias("q"), "born", "bucket")
    )
    run = (
        Window.partitionBy("key", "bucket", "part")
        .orderBy(F.col("at").asc_nulls_first(), F.col("q").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = _in_parts(line.unionByName(carried), hot)
    alive = F.when(F.col("q.ever"), F.sum("born").over(run)).otherwise(F.sum("change").over(run))
    counted = counted.withColumn("alive", alive).filter(F.col("q").isNotNull())
    return counted.select("key", F.when(~F.col("q.ever"), F.col("at")).alias("at"), "q.p.*", "alive")
