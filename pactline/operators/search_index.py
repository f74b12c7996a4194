"""Prefix search: postings of words, sorted by word and stored by first letter, so that a term reads its own range only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lead(term: Column) -> Column:
    """Folder of a word: its first letter or figure; all other beginnings share one."""
    return F.when(term.rlike("^[a-z0-9]"), F.concat(F.lit("w"), F.substring(term, 1, 1))).otherwise("w_")


def write_index(rows: DataFrame, words: Column, path: str, key: str = "id") -> None:
    """Store (term, id) postings of the word array `words` of every row. Rows without a word or an id have none.

    Postings are ranged by term and id, so a word that a third of all rows hold is spread over several files.
    """
    postings = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(F.array_distinct(words)).alias("term")).where("term <> ''")
    led = postings.withColumn("lead", _lead(F.col("term")))
    out = led.repartitionByRange("term", "id").sortWithinPartitions("lead", "term", "id")
    led.limit(0).write.mode("overwrite").parquet(f"{path}/layout")   # the types, also of an index without postings
    out.write.mode("overwrite").partitionBy("lead").parquet(f"{path}/postings")


def needed_terms(terms: list[str]) -> list[str]:
    """Distinct terms without those that begin another one, which are met whenever the longer one is."""
    distinct = sorted(set(terms))
    return [t for t in distinct if not any(o != t and o.startswith(t) for o in distinct)]


def postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(id, n) of words that start with term number n. Folders are pruned by the first letter, row groups by the prefix."""
    stored = spark.read.schema(spark.read.parquet(f"{path}/layout").schema).parquet(f"{path}/postings")
    folder = lambda t: "w" + t[0] if t[0] in "abcdefghijklmnopqrstuvwxyz0123456789" else "w_"
    fits = [F.startswith("term", F.lit(t)) for t in terms]
    one = reduce(lambda a, b: a | b, fits)
    number = reduce(lambda rest, i: F.when(fits[i], F.lit(i)).otherwise(rest), range(len(terms)), F.lit(None).cast("int"))
    return stored.where(F.col("lead").isin(*sorted({folder(t) for t in terms})) & one).select("id", number.alias("n"))


def find(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Ids whose words start with every term: postings are counted by id, no text is read. Lower-case terms, at least one."""
    wanted = needed_terms(terms)
    if not wanted or "" in wanted:
        raise ValueError("a search needs a term, and a term a letter")
    found = postings(spark, path, wanted)
    if len(wanted) == 1:
        return found.select("id").distinct()
    return found.groupBy("id").agg(F.count_distinct("n").alias("met")).where(F.col("met") == len(wanted)).select("id")
