"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feed, rollups
from . import frames
from . import q_aggs, q_outputs, q_sources, q_text  # noqa: F401
from .registry import QUERIES, SQL, tuned

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines -> deal filter -> parse -> story rollup -> ranked window."""
    stories = rollups.cluster_rollup(frames.items(tuned(spark), sf_dir)).withColumnRenamed("cluster_id", "id")
    start = feed.window_start(F.lit(frames.PREVIOUS).cast("timestamp"), frames.now())
    return feed.top_stories(stories, start, 25).select(
        "rank", "id", "headline", "outlet_count", "item_count", "last_published", F.array_join("industries", ", ").alias("industries"))
