"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one fresh folder for a local session that has none set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = session.shared_folder(spark)  # refuses on a cluster
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once per session, unless their path holds it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    key = "pactline.shipped"
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get(key, None) == spark.sparkContext.applicationId:
        return spark
    package = os.path.join(root, "pactline")
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "pactline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    spark.conf.set(key, spark.sparkContext.applicationId)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read back, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """`name`, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so a task never holds many decoded long texts at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
