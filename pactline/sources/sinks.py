"""Writers: public documents, shards, run statistics, guarded replacement, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geo import SHARDS

KEEP_DAYS = 120


def public_docs(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One JSON document per entity, limited to the allowed columns."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("doc"))


def write_docs(df: DataFrame, columns: list[str], key: str, path: str) -> None:
    public_docs(df, columns, key).write.mode("overwrite").json(path)


def with_shard(details: DataFrame, key: str = "crd") -> DataFrame:
    return details.withColumn("shard", F.pmod(F.col(key).cast("bigint"), F.lit(SHARDS)).cast("int"))


def write_shards(details: DataFrame, path: str, key: str = "crd") -> None:
    """One folder per shard. Repartitioning on the shard and a salt keeps several writers per shard at scale."""
    out = with_shard(details, key)
    out.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("shard").json(path)


def retained(stats: DataFrame, now: Column, days: int = KEEP_DAYS, at: str = "run_at") -> DataFrame:
    return stats.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def write_stats(run: DataFrame, path: str, at: str = "run_at") -> None:
    """Add the statistics of a run. A run date is a folder; writing a date again replaces that folder and no other."""
    dated = run.withColumn("run_date", F.to_date(at))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def live_stats(spark: SparkSession, path: str, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Statistics of the last `days` run dates before today's; folders of other dates are not read."""
    return spark.read.parquet(path).where(F.col("run_date") >= F.date_sub(now, days))


def replaced(new: DataFrame, old: DataFrame, min_rows: int) -> DataFrame:
    """The new dimension, or the old one when the new load is suspiciously small."""
    enough = new.limit(min_rows).count() >= min_rows
    return new if enough else old


POINTER = "version long, folder string"


def replace_dimension(new: DataFrame, path: str, min_rows: int, keep: int = 2) -> bool:
    """Swap a stored dimension for a new load, unless that is suspiciously small; tells whether it did.

    The load goes to a folder of its own, and a pointer row that names the folder is committed last. A write that is cut short leaves
    a folder that no pointer names, and readers stay with the version before. Versions older than the last `keep` are emptied.
    """
    if new.limit(min_rows).count() < min_rows:
        return False
    spark = new.sparkSession
    known = _pointers(spark, path)
    version = (known[-1][0] if known else 0) + 1
    folder = f"version={version}-{uuid.uuid4().hex}"
    new.write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(version, folder)], POINTER).coalesce(1).write.mode("append").json(f"{path}/pointers")
    for _, old in known[:max(0, len(known) + 1 - keep)]:
        new.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/{old}")
    return True


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The committed versions, oldest first: one small row for each replacement."""
    spark.createDataFrame([], POINTER).coalesce(1).write.mode("ignore").json(f"{path}/pointers")
    return sorted(map(tuple, spark.read.schema(POINTER).json(f"{path}/pointers").collect()))


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The version the last committed pointer names."""
    known = _pointers(spark, path)
    if not known:
        raise FileNotFoundError(f"no committed version below {path}")
    return spark.read.parquet(f"{path}/{known[-1][1]}")
