"""Streams with keyed state of their own: first sightings, and counts by day that close, or expire, as the watermark passes.

Rows are added up inside each input partition before they are shuffled to their key, so a key of many rows is a few rows in each
batch. The processors need the RocksDB state store, which `keyed_state` sets for the session.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dates

# Python workers need no copy of the package: what they run is sent to them whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _partial(stream: DataFrame, keys: list[str], value: str, how: str) -> DataFrame:
    """One row for each key of each Arrow batch: the sum or the least of `value`."""
    kinds = dict(stream.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(keys, use_threads=False).aggregate([(value, how)]).rename_columns([*keys, value])
            yield from t.to_batches()

    return stream.select(*keys, value).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, value]))


class FirstSeen(StatefulProcessor):
    """The least number seen for a key; a row goes out only when it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = min(int(df["at"].min()) for df in rows)
        if not self.first.exists() or at < self.first.get()[0]:
            self.first.update((at,))
            yield pd.DataFrame({"key": [key[0]], "at": [at]})

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first_seen) of the keys whose first sighting is new or earlier than known; update output, one value a key as state.

    Rows without a time are left out; a null key is a key. State grows with the number of keys, as nothing may be forgotten.
    """
    keyed_state(stream.sparkSession)
    kind = dict(stream.dtypes)[key]
    rows = _partial(stream.where(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(at).alias("at")), ["key"], "at", "min")
    out = rows.groupBy("key").transformWithStateInPandas(FirstSeen(), f"key {kind}, at long", "Update", "None")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias("first_seen"))


class DayCount(StatefulProcessor):
    """The rows of one day and key until `due`; with `running` every change goes out, without only the closed count."""

    def __init__(self, running: bool):
        self.running = running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("n", "n long")

    def row(self, key, n: int, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"day": [key[0]], "key": [key[1]], "n": [n], "row_kind": [kind]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = sum(int(df["n"].sum()) for df in rows)
        if key[2] <= timerValues.getCurrentWatermarkInMs():
            yield self.row(key, n, "late")
            return
        if self.count.exists():
            n += self.count.get()[0]
        else:
            self.handle.registerTimer(key[2])
        self.count.update((n,))
        if self.running:
            yield self.row(key, n, "running")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0]
        self.count.clear()
        yield self.row(key, 0 if self.running else n, "expired" if self.running else "closed")

    def close(self) -> None:
        pass


def _day_counts(stream: DataFrame, at: str, by: str, zone: str, delay: str, hold_days: int, running: bool) -> DataFrame:
    keyed_state(stream.sparkSession)
    kind = dict(stream.dtypes)[by]
    day = dates.local_day(F.col(at), zone)
    due = F.unix_millis(F.to_utc_timestamp(F.date_add(day, 1 + hold_days).cast("timestamp"), zone))
    rows = stream.where(F.col(at).isNotNull()).withWatermark(at, delay).select(day.cast("string").alias("day"), F.col(by).alias("key"), due.alias("due"), F.lit(1).cast("long").alias("n"))
    out = _partial(rows, ["day", "key", "due"], "n", "sum").groupBy("day", "key", "due").transformWithStateInPandas(
        DayCount(running), f"day string, key {kind}, n long, row_kind string", "Update" if running else "Append", "EventTime")
    return out.select("day", F.col("key").alias(by), "n", "row_kind")


def closed_days(stream: DataFrame, at: str, by: str, zone: str = dates.LOCAL_ZONE, delay: str = "1 day") -> DataFrame:
    """(day, key, n, row_kind) in append mode: `closed` once the watermark passes the end of a local day, whose state then goes;
    `late` for rows of a day that was closed before they came. The sum of both is the count of all rows."""
    return _day_counts(stream, at, by, zone, delay, 0, False)


def retained_counts(stream: DataFrame, at: str, by: str, keep_days: int, delay: str = "0 seconds") -> DataFrame:
    """(day, key, n, row_kind) in update mode: the `running` count of a UTC day, and `expired` when the watermark is `keep_days` past its
    end and its state goes. Rows that arrive after that are `late` and not kept."""
    return _day_counts(stream, at, by, "UTC", delay, keep_days, True)
