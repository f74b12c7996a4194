"""Training-corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

`STAGES` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
to the shared folder and read again as the next stage's documents. All but the last return the columns of documents. Stages
look at the named columns only; other columns of the input are left behind.

The classifier cannot be stated in SQL, so `ORACLE_SQL` is None and the tests hold the result against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm import best_fit_packing, line_spread, near_dedup, phrase_index, quality_ranking
from pactline.llm.common import shared_path, table
from pactline.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking predicts to be good."""
    own = docs.select(*COLUMNS)
    model = quality_ranking.fit(own, table(spark, sf_dir, "labels"))
    return quality_ranking.score_documents(own, model, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated cross-site lines; a document of which nothing is left goes."""
    out = line_spread.remove_boilerplate(docs.select(*COLUMNS))
    left = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8), the one with the smallest id."""
    own = docs.select(*COLUMNS)
    kept = near_dedup.classes(own, size=5, percent=80, text_hash=True).where("kept").select(F.col("doc_id").alias("_k"), F.col("t").alias("_t")).distinct()
    left = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_k")) & (F.xxhash64("text") == F.col("_t")), "left_semi")
    # rows that repeat one id and text are one document
    return left.withColumn("_t", F.xxhash64("text")).dropDuplicates(["doc_id", "_t"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark windows."""
    own = docs.select(*COLUMNS)
    found = phrase_index.contamination(own, table(spark, sf_dir, "benchmark"))
    bad = found.where(phrase_index.contaminated()).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
    return own.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return best_fit_packing.pack_documents(docs.select(*COLUMNS), tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
