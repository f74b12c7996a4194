"""Session defaults and the few helpers that look at the size of a frame before choosing a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension is only hinted for broadcast when it is proven to hold no more rows than this.
BROADCAST_ROWS = 200_000


def build_session(app: str = "pactline", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the frame is shown to be small; otherwise leave the join to AQE.

    The check reads at most `rows + 1` rows, so its cost does not grow with an oversized frame.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may do without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: the frame is written once, as a compressed table in the checkpoint folder of the cluster, and read back from it by
    column. Checkpoints of Spark hold whole uncompressed rows instead."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir() or shared_folder(spark)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
