"""Structured Streaming jobs. Each transformation takes a streaming (or static) frame; `drain` runs a query to the end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..session import shared_folder


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/pactline-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of Parquet files with the columns of a known frame."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], mode: str, folder: str) -> None:
    """Process everything available, then stop. The checkpoint makes a restarted run continue where it stopped."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Writer for append and update results: a re-run batch replaces its own folder, so delivery is exactly once."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def result(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What a stream wrote, read with the schema of the transformation."""
    return spark.read.schema(like.schema).option("recursiveFileLookup", True).parquet(path)


# ---------------------------------------------------------------- ingest
def fresh_rows(stream: DataFrame, at: str, fetched: Column, max_age_days: int) -> DataFrame:
    """Late rows within the allowed age; times more than a day ahead are re-stamped."""
    when = dates.published_or_fetched(F.col(at), fetched)
    out = stream.withColumn("_w", when).withColumn(at, F.col("_w.at")).withColumn("estimated", F.col("_w.estimated")).drop("_w")
    return out.where(F.col(at) >= fetched - F.make_dt_interval(F.lit(max_age_days))) if max_age_days else out


# ---------------------------------------------------------------- aggregates
def day_members(stream: DataFrame, at: str, key: str, member: str, delay: str = "8 days") -> DataFrame:
    """Each (day, key, member) once, in append mode. State is bounded by the watermark; rows later than that are dropped and counted in
    the progress of the query."""
    rows = stream.select(F.date_trunc("day", F.col(at)).alias("day"), key, member).where("day is not null")
    return rows.withWatermark("day", delay).dropDuplicates(["day", key, member])


def member_counts(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that adds a batch's new members up by day and key."""
    write = batch_folder(path)
    return lambda df, batch: write(df.groupBy("day", key).agg(F.count(F.lit(1)).alias("n")), batch)


def trailing(counts: DataFrame, key: str, days: int = 7) -> DataFrame:
    """(until, key, n): members are distinct inside a day, so a window that moves by one day is the sum of its days."""
    ends = F.explode(F.sequence(F.lit(1), F.lit(days)))
    moved = counts.groupBy("day", key).agg(F.sum("n").alias("n")).select(key, "n", "day", ends.alias("k"))
    return moved.groupBy(F.date_add(F.to_date("day"), F.col("k")).alias("until"), key).agg(F.sum("n").alias("n"))


def alerts(batch: DataFrame, terms: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """One row per group with the watch names its rows of this batch hit."""
    from ..operators.firms import watch_hits

    hits = watch_hits(batch, key, text, terms)
    return batch.select(key, group).join(hits, key).groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.countDistinct(key).alias("items"))
