"""Session helpers: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a temporary folder;
    on a cluster a machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="tesserae-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that nothing will read again."""
    for df in tables:
        rdd = df._jdf.queryExecution().logical().rdd()
        kept = rdd.getCheckpointFile()
        if kept.isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(kept.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast hint only below ``limit`` rows; ``rows`` is the counted size."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` in enough partitions to busy all cores, for work that costs far more than its input.

    Large inputs already are, and are left alone; only a small one is shuffled.
    For plans without a shuffle: counting partitions would run one.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
