"""Session construction and shared-storage helpers.

Library code never builds its own session; callers pass one in. ``local_session``
is for tests, ``bench.py`` and ad-hoc use. ``scratch_path`` returns a location
under the cluster's shared ``spark.checkpoint.dir`` for materialised tables.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "dualcheck") -> SparkSession:
    """A local session with the settings the tests and the bench assume."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DUALCHECK_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a private one only in local mode.

    On a cluster the operator configures ``spark.checkpoint.dir`` to shared
    storage and this function only reads it; without it the call fails. Only
    where driver and executors are one machine (``local[...]``) a temporary
    folder stands in.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="dualcheck-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


#: The largest method, in bytes, that HotSpot compiles.
COMPILED_BYTES = 8000
METHOD_LIMIT_KEY = "spark.sql.codegen.hugeMethodLimit"


def limit_methods(spark: SparkSession) -> None:
    """Let plans whose generated methods HotSpot would only interpret run as separate
    projections, which it compiles. Spark's default lets methods of 65,535 bytes pass;
    the audit's row-local chain is such a plan."""
    spark.conf.set(METHOD_LIMIT_KEY, str(COMPILED_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of a narrow table that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def small_or_dealt(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few columns, marked for broadcast where it has at most
    ``most`` rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Codec of written tables: about half of Snappy's bytes for the texts here.
CODEC = "zstd"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back (cuts lineage).

    Used where recomputation would be wrong or costly: model answers must not
    be requested twice, and two passes over a range-partitioned table must see
    the same partitions. Survives executor loss because the data lives in the
    shared folder, not on an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", CODEC).parquet(path)
    return spark.read.parquet(path)


def materialize_dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """``materialize``, in buckets of ``key``: tables that are parts of the result meet on ``key`` without a shuffle.

    There are as many buckets as shuffle partitions; where ``df`` is dealt by ``key`` to as many, each task writes one
    file. The table's entry in the catalog goes at once, as the folder and the frame that reads it are all that is needed.
    """
    spark = df.sparkSession
    path, n = scratch_path(spark, name), shuffle_partitions(spark)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(n, key).option("path", path).option("compression", CODEC).format("parquet").saveAsTable(table)
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE `{table}`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
