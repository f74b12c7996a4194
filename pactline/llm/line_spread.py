"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

Each non-blank line, trimmed, is hashed; HyperLogLog sketches of its sites merge by aggregation, so a line of millions of
rows costs one sketch per task. Lines whose estimate lies clearly above the threshold are boilerplate, those clearly below
are not, and lines within the error band get an exact distinct count. Of a boilerplate line the first occurrence (smallest
document id, then position) stays, so no content is lost from the corpus; `keep_first=False` removes all.

Defined cases: a null text has no lines and stays null; blank lines are never removed; a null site counts as one site of its
own; repeated rows are treated alike; rows that share an id but not the text are told apart by a hash of the text. Further
columns of the input are returned unchanged; input columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices, written

MIN_SITES = 10
LG_K = 10
# Relative half-width of the band in which the sketch is not trusted: five standard errors of a sketch with 2**LG_K registers.
BAND = 5 * 1.04 / (2 ** LG_K) ** 0.5


def _line_hash(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.hash(line, F.length(line)).alias("h2")]


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, t, pos, h1, h2, site) of every non-blank line; pos counts all lines from 0."""
    split = docs.select("doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"),
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    split = split.select("doc_id", "t", "site", "pos", F.trim("line").alias("line")).where("line <> ''")
    return split.select("doc_id", "t", "pos", "site", *_line_hash(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first) of the lines that stand on at least `min_sites` distinct sites."""
    seen = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "t")).alias("first"))
    # a line of fewer rows than sites asked for cannot qualify; this only drops certain misses
    seen = written(seen.where(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    sure = seen.where(F.col("sites") > min_sites * (1 + BAND)).select("h1", "h2", "first")
    near = seen.where((F.col("sites") <= min_sites * (1 + BAND)) & (F.col("sites") >= min_sites * (1 - BAND) - 1)).select("h1", "h2", "first")
    exact = (lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
             .groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites))
    return sure.union(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", keep_first: bool = True) -> DataFrame:
    """`docs` with cleaned `text`, plus n_lines (non-blank) and n_removed."""
    lines = lines_of(docs, site)
    found = written(boilerplate(lines, min_sites), "boilerplate")
    out = lines.join(found, ["h1", "h2"])
    if keep_first:
        out = out.where(~F.struct("doc_id", "pos", "t").eqNullSafe(F.col("first")))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    drop = free_name("_drop", own)
    drops = out.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set("pos").alias(drop))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.xxhash64("text").alias("_h"))
    tagged = keyed.join(drops, F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left").select("row.*", drop)
    at = own.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, counts, removed = [], [], []
            for text, drop in zip(b.column(at).to_pylist(), b.column(len(own)).to_pylist(), strict=True):
                lines_ = [] if text is None else text.split("\n")
                counts.append(sum(1 for x in lines_ if x.strip(" ")))
                gone = set(drop or ())
                removed.append(len(gone))
                texts.append("\n".join(x for i, x in enumerate(lines_) if i not in gone) if gone else text)
            columns = [*(b.column(i) for i in range(len(own))), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, [*own, "n_lines", "n_removed"])

    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in own]
                          + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return tagged.mapInArrow(clean, schema)
