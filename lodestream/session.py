"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a materialised, counted side may be broadcast.
BROADCAST_ROWS = 200_000


def get_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as the tests and the bench use it; clusters pass their own."""
    return (
        SparkSession.builder.master(master)
        .appName("lodestream")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's own setting, else, with a local master only, one for tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-lodestream-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for tables an operator writes."""
    base = shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on whatever file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder an operator wrote, on whatever file system it lies."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted size allows it; otherwise leave the join to shuffle.

    ``df`` must be cheap to count (a checkpoint or a tiny scan).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
