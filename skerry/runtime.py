"""Session helpers shared by every operator: table loading, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its row count times its row width stays under this many bytes.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder of ``spark.checkpoint.dir``; where that is unset, at one in the session's warehouse.

    The warehouse is the file system that the session shares with its executors, so no machine keeps a part to itself.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(where or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints/{uuid.uuid4().hex}")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share, for tables written between stages."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting ``df``; beyond the limit Spark is left to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def default_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def local_session(cores: str | None = None, app: str = "skerry") -> SparkSession:
    """The session that tests and benches use; on a cluster the session comes from spark-submit."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("SKERRY_DRIVER_MEMORY", "12g"))
        .config("spark.sql.warehouse.dir", os.environ.get("SKERRY_WAREHOUSE", "/tmp/skerry-warehouse"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
