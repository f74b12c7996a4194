"""Exact top-k inner products over norm-sorted blocks.

Vectors are cut into bands by descending length, bands into blocks of bounded size. A rotation by the right singular vectors
of the data gathers the weight of all vectors in the first coordinates. A query first meets the longest band, which gives it
a lower bound for its k-th score. It then visits only bands whose longest vector can still reach that bound (Cauchy-Schwarz).
Inside a block, candidates come by descending length; sums over the first rotated coordinates plus the product of the residual
lengths bound each score, and only candidates whose bound reaches the k-th score get the exact integer product; a tile in
which many stay open gets the integer products of all its candidates at once.

Defined cases: null vectors and vectors with null or non-finite components take no part, nor do rows without an id; rows of
one id count as one vector (the smallest); shorter vectors are filled up with zeros; equal scores go to the smaller id; fewer
than k candidates give all of them; components beyond 2**53 / 256 and scores beyond a long saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 4_096
QUERY_BLOCK = 1_024
BANDS = 64
TILE = 512
_BIG = 2 ** 53


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, q): q holds floor(256 * component) as integers; rows that take no part are left out."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * 256, F.lit(float(_BIG))), F.lit(-float(_BIG)))).cast("long"))
    return (vectors.where(F.col(vec_id).isNotNull() & x.isNotNull()).where(whole).select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"))
            .groupBy("vec_id").agg(F.min("q").alias("q")))


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of the data, strongest first, from the d x d second moments summed by Spark."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0).to_pylist(), d)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(g.ravel())], ["k", "v"])

    got = vectors.select("q").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    g = np.zeros(d * d)
    g[got["k"].to_numpy()] = got["v"].to_numpy()
    values, axes = np.linalg.eigh(g.reshape(d, d))
    return axes[:, np.argsort(-values)]


def _matrix(rows: list, d: int) -> np.ndarray:
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of paired rows; in floats while all partial sums are exact, else in whole numbers."""
    if (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * q.shape[1] < _BIG:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([max(-2 ** 63, min(2 ** 63 - 1, w)) for w in whole], np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, k: int) -> list[tuple]:
    """(query, id, score): each query's best k of one block, leaving out scores below its bound `least`."""
    order = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")
    ids, x = ids[order], x[order]
    h = max(1, x.shape[1] // 4)
    qr, xr = q @ axes, x @ axes
    q_rest, x_rest = np.linalg.norm(qr[:, h:], axis=1), np.linalg.norm(xr[:, h:], axis=1)
    q_len, x_len = np.linalg.norm(qr, axis=1), np.linalg.norm(xr, axis=1)
    exact_floats = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * q.shape[1] < _BIG
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    bound = least.astype(float)
    for lo in range(0, len(x), TILE):
        hi = min(len(x), lo + TILE)
        live = np.flatnonzero(q_len * x_len[lo] * (1 + 1e-9) + 1e-6 >= bound)  # the tile's longest vector comes first
        if not len(live):
            break
        # rounding of the rotated sums stays far below this share of the lengths
        upper = qr[live, :h] @ xr[lo:hi, :h].T + q_rest[live, None] * x_rest[None, lo:hi] + (1e-9 * q_len[live, None] * x_len[None, lo:hi] + 1e-6)
        open_ = upper >= bound[live, None]
        if exact_floats and open_.mean() > 0.02:
            # so many candidates are open that one product over the tile costs less than gathering them
            score_ = q[live] @ x[lo:hi].T
            a, b = np.nonzero(open_ & (score_ >= bound[live, None]) & (q_ids[live, None] != ids[None, lo:hi]))
            score = score_[a, b].astype(np.int64)
        else:
            a, b = np.nonzero(open_ & (q_ids[live, None] != ids[None, lo:hi]))
            score = _exact(q[live[a]], x[b + lo])
        cuts = np.searchsorted(a, np.arange(len(live) + 1))
        for row in np.unique(a):
            r, m = live[row], slice(cuts[row], cuts[row + 1])
            s, i = np.concatenate((best[r][0], score[m])), np.concatenate((best[r][1], ids[b[m] + lo]))
            top = np.lexsort((i, -s)) if s.min() > -2 ** 63 else np.array(sorted(range(len(s)), key=lambda j: (-int(s[j]), int(i[j]))))
            best[r] = (s[top[:k]], i[top[:k]])
            if len(top) >= k:
                bound[r] = max(bound[r], np.nextafter(float(best[r][0][-1]), -np.inf) if not exact_floats else float(best[r][0][-1]))
    return [(int(q_ids[r]), int(i), int(s)) for r, (ss, ii) in enumerate(best) for s, i in zip(ss, ii, strict=True) if s >= least[r]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows marked by `is_query` (a condition on vec_id) against all other rows."""
    all_ = written(quantised(vectors, vec_id, vector).withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))), "vectors")
    facts = all_.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d"), F.count(F.when(is_query, 1)).alias("nq")).first()
    n, d, nq = facts["n"], max(1, facts["d"] or 1), facts["nq"]
    axes = rotation(all_, d)
    bands = max(1, min(BANDS, -(-n // BLOCK)))
    cuts = sorted(set(all_.agg(F.percentile_approx("norm", [1 - (b + 1) / bands for b in range(bands - 1)] or [0.0], 10_000)).first()[0] or []), reverse=True)
    cuts = cuts if bands > 1 else []
    band = F.lit(0)
    for c in cuts:  # band 0 holds the longest vectors
        band = band + F.when(F.col("norm") < F.lit(float(c)), 1).otherwise(0)
    banded = all_.withColumn("band", band)
    shape = {r["band"]: r for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}  # at most BANDS rows
    layout, at = [], 0
    for b in sorted(shape):
        blocks = -(-shape[b]["n"] // BLOCK)
        layout.append((b, at, blocks, float(shape[b]["longest"])))
        at += blocks
    q_blocks = max(1, -(-nq // QUERY_BLOCK))
    queries = all_.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("q").alias("sought"), F.col("norm").alias("length"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"))

    def visit(these: list[tuple], asked: DataFrame) -> DataFrame:
        """Blocks of the given bands against `asked` (query_id, sought, length, qb, least)."""
        layout_ = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(a).alias("first"), F.lit(m).alias("blocks"), F.lit(x).alias("longest")) for b, a, m, x in these])
        sent = (asked.withColumn("l", F.explode(layout_)).where(F.col("length") * F.col("l.longest") * (1 + 1e-9) + 1e-6 >= F.col("least"))
                .withColumn("block", F.explode(F.sequence(F.col("l.first"), F.col("l.first") + F.col("l.blocks") - 1)))
                .select("block", "qb", "query_id", "sought", "least"))
        first = F.element_at(F.create_map(*[F.lit(v) for b, a, m, _ in these for v in (b, a)]), F.col("band"))
        count = F.element_at(F.create_map(*[F.lit(v) for b, a, m, _ in these for v in (b, m)]), F.col("band"))
        dealt = (banded.where(F.col("band").isin([b for b, *_ in these])).withColumn("block", (first + F.pmod(F.xxhash64("vec_id"), count)).cast("int"))
                 .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).select("block", "qb", "vec_id", "q"))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            got = search_block(left["query_id"].to_numpy(), _matrix(list(left["sought"]), d), left["least"].to_numpy(), right["vec_id"].to_numpy(),
                               _matrix(list(right["q"]), d), axes, k)
            return pd.DataFrame(got, columns=["query_id", "vec_id", "score"], dtype="int64")

        return sent.groupBy("block", "qb").cogroup(dealt.groupBy("block", "qb")).applyInPandas(meet, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if not layout:
        return all_.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    none = F.lit(float("-inf"))
    found = written(best(visit(layout[:1], queries.withColumn("least", none))), "longest")
    if len(layout) == 1:
        return found
    # as a double, lowered a little where doubles no longer hold every whole number
    low = F.col("score").cast("double") - F.when(F.abs(F.col("score").cast("double")) > _BIG, F.abs(F.col("score").cast("double")) * 1e-15).otherwise(0.0)
    least = found.where(F.col("rank") == k).select("query_id", low.alias("least"))
    asked = queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", none))
    return best(visit(layout[1:], asked).union(found.select("query_id", "vec_id", "score")))
