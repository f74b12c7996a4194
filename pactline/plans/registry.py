"""Registry of queries and the plain SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tuned(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on; cluster sizes are left to the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # headline parsing is heavy per byte, so small shuffles may still spread over all cores
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32KB")
    # HotSpot compiles no method above 8000 bytes: long chains of column expressions fused into one would be interpreted for every row,
    # so they run operator by operator, each with generated code of its own
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def job(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise KeyError(f"query registered twice: {key}")
        QUERIES[key] = lambda spark, sf: fn(tuned(spark), sf)
        if sql is not None:
            SQL[key] = sql
        return fn
    return add


def ts(col: str | Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def big(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def joined(col: str | Column, sep: str = "|") -> Column:
    return F.array_join(col, sep)
