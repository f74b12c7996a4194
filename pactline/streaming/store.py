"""An item store that answers "is this key new?" without being read whole.

Items are written by batch and key bucket. Beside each bucket of a batch stands a Bloom filter of its keys, a bit array sized by
their number. A new batch meets the filters of its buckets; only the folders of buckets and batches whose filter may hold one of its
keys are read for the exact comparison. A batch that runs again replaces its own folders and ignores its earlier self.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 12, 6
INDEX = "bucket int, batch long, bits binary"

# Python workers need no copy of the package: what they run is sent to them whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bloom(h1: np.ndarray, h2: np.ndarray, bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES) -> bytes:
    """The bit array of keys given by two 64-bit hashes each."""
    size = 8 * -(-max(64, bits_per_key * len(h1)) // 8)
    flags = np.zeros(size, bool)
    flags[_places(h1, h2, size, hashes).ravel()] = True
    return np.packbits(flags).tobytes()


def may_hold(bits: bytes, h1: np.ndarray, h2: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Which keys the filter may hold; never false for a key it was made from."""
    flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return flags[_places(h1, h2, len(flags), hashes)].all(axis=0)


def _places(h1: np.ndarray, h2: np.ndarray, size: int, hashes: int) -> np.ndarray:
    a, b = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(hashes)]).astype(np.int64)


class ItemStore:
    """Insert-or-ignore by key. `buckets` stays the same for the life of a store; null keys are one key."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        # an index of no rows, so that the first batch finds one
        spark.createDataFrame([], INDEX).write.mode("ignore").parquet(f"{path}/index/batch_of=none")

    def placed(self, df: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(self.key).cast("string"), F.lit("\0"))
        return df.withColumns({"bucket": F.pmod(F.xxhash64(text), F.lit(self.buckets)).cast("int"), "h1": F.xxhash64(text, F.lit(1)), "h2": F.xxhash64(text, F.lit(2))})

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).option("recursiveFileLookup", True).parquet(f"{self.path}/index")

    def suspects(self, rows: DataFrame, batch: int) -> list[tuple[int, int]]:
        """(batch, bucket) folders of other batches that may hold a key of `rows`: at most one for each filter of the index."""
        filters = self.index().where(F.col("batch") != batch)

        def test(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = keys["h1"].to_numpy(), keys["h2"].to_numpy()
            hit = [(int(b), int(k)) for b, k, bits in zip(held["batch"], held["bucket"], held["bits"], strict=True) if len(h1) and may_hold(bits, h1, h2).any()]
            return pd.DataFrame(hit, columns=["batch", "bucket"]).astype({"batch": "int64", "bucket": "int32"})

        got = rows.select("bucket", "h1", "h2").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "batch long, bucket int")
        return sorted(map(tuple, got.collect()))

    def known(self, folders: list[tuple[int, int]]) -> DataFrame | None:
        """The keys of some folders, and of no others."""
        paths = [f"{self.path}/items/batch={b}/bucket={k}" for b, k in folders]
        return self.spark.read.parquet(*paths).select(F.col(self.key).alias("_known")) if paths else None

    def insert(self, df: DataFrame, batch: int) -> None:
        """Add the rows of `df` whose key no other batch holds; of rows with one key any one."""
        rows = self.placed(df.dropDuplicates([self.key])).persist()
        known = self.known(self.suspects(rows, batch))
        fresh = rows if known is None else rows.join(known, F.col(self.key).eqNullSafe(F.col("_known")), "left_anti")
        own = f"{self.path}/items/batch={batch}"
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(own)
        written = self.spark.read.schema(fresh.schema).parquet(own).select("bucket", "h1", "h2")

        def make(t: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": [int(t["bucket"].iloc[0])], "batch": [batch], "bits": [bloom(t["h1"].to_numpy(), t["h2"].to_numpy())]}).astype({"bucket": "int32"})

        # the filters come last: items of a batch that was cut short are replaced when it runs again
        written.groupBy("bucket").applyInPandas(make, INDEX).write.mode("overwrite").parquet(f"{self.path}/index/batch_of={batch}")
        rows.unpersist()

    def items(self, batch: int | None = None) -> DataFrame:
        """All items, or those one batch added."""
        got = self.spark.read.option("basePath", f"{self.path}/items").parquet(f"{self.path}/items" + ("" if batch is None else f"/batch={batch}"))
        return got.drop("h1", "h2", "bucket", "batch")


def insert_into(store: ItemStore) -> Callable[[DataFrame, int], None]:
    """Batch writer of a stream."""
    def write(df: DataFrame, batch: int) -> None:
        store.insert(df, batch)
    return write
