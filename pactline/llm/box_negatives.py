"""Hard negatives from a sort-tile-recursive packed tree of bounding boxes.

Vectors are cut into slabs by the quantiles of the coordinate of highest variance, slabs into tiles by the next one, and tiles
that ties left too large into parts. Inside a tile rows are packed the same way into leaves, and leaves into inner nodes. Every
box keeps the least and largest value of each coordinate, so an anchor's inner products with its rows lie in an interval that is
the sum of the coordinates' intervals.

A search is a request for the `k` best rows of the anchor's label, or of other labels with scores inside a window. Directories of
tile boxes are met first: each request visits the tile of the highest reachable score, which gives it a bound for its kth score,
and afterwards every tile whose interval meets the window and reaches that bound. In a tile a best-first queue opens the nodes by
their highest reachable score and stops when that lies strictly below the kth, so ties are kept. Requests of a popular tile are
dealt to parts of bounded size; a tile is one row of bounded size. Positives are searched first, then negatives for each distinct
(anchor vector, positive score).

Of rows with equal label and vector only the first k + 1 ids can enter a list, so copies are cut to these before the tree is
built; equal anchors share one request. Neither loses a result.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part, nor do rows without an id;
rows equal in id, label and vector are one row, rows that share an id but differ are rows of their own; shorter vectors are filled
up with zeros; ties go to the smaller id; an anchor without positives, or a positive without negatives in its window, gives no
rows; negative positive scores have empty windows; components beyond 2**53 / 256 and scores beyond a long saturate; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS
from .common import written
from .topk_search import _exact, _matrix

TILE, LEAF, FAN = 4_096, 32, 8  # rows of a tile and of a leaf, leaves of an inner node
DIRECTORY = 8_192  # tile boxes in one directory
PART = 512  # requests that meet a tile at once
K = 5
_BIG = 2 ** 53
_HUGE = 2 ** 63 - 1


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, key): rows that take part, each once; every seventh id's label is moved on; key names label and vector."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * 256, F.lit(float(_BIG))), F.lit(-float(_BIG)))).cast("long"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), q.alias("q")).distinct()
    return rows.withColumn("key", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("q").cast("array<string>")).cast("binary")))


def busiest(rows: DataFrame, d: int, how_many: int = 2) -> list[int]:
    """The coordinates of highest variance, from d sums and d sums of squares added up by Spark."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(d), np.zeros(d)
        for b in batches:
            x = _matrix(b.column(0).to_pylist(), d)
            n, s, ss = n + len(x), s + x.sum(0), ss + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([float(n)] * d), pa.array(s), pa.array(ss)], ["c", "n", "s", "ss"])

    got = rows.select("q").mapInArrow(moments, "c long, n double, s double, ss double").groupBy("c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).toPandas().sort_values("c")
    variance = got["ss"] / got["n"] - (got["s"] / got["n"]) ** 2
    return [int(c) for c in np.argsort(-variance.to_numpy(), kind="stable")[:how_many]]


def tiled(rows: DataFrame, n: int, d: int, tile: int = TILE) -> DataFrame:
    """`rows` with the number of their tile: slabs by quantiles of one coordinate, tiles by quantiles of another in each slab."""
    axes = busiest(rows, d)
    at = lambda k: F.coalesce(F.get("q", F.lit(axes[min(k, len(axes) - 1)])), F.lit(0)).cast("double")
    slabs = max(1, round((n / tile) ** 0.5))
    within = max(1, -(-n // (slabs * tile)))
    steps = lambda m: [(k + 1) / m for k in range(m - 1)] or [0.0]
    over = lambda v, cuts: F.size(F.filter(cuts, lambda c: c < v))
    if slabs > 1:
        cuts = sorted(set(rows.agg(F.percentile_approx(at(0), steps(slabs), 10_000)).first()[0]))
        rows = rows.withColumn("slab", over(at(0), F.array(*[F.lit(float(c)) for c in cuts])))
    else:
        rows = rows.withColumn("slab", F.lit(0))
    # as many numbers as tiles; the join is left to the planner
    inner = rows.groupBy("slab").agg(F.percentile_approx(at(1), steps(within), 10_000).alias("cuts"))
    rows = rows.join(inner, "slab").withColumn("cell", over(at(1), F.col("cuts")) if within > 1 else F.lit(0)).drop("cuts")
    size = rows.groupBy("slab", "cell").agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts"))
    rows = rows.join(size, ["slab", "cell"])
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "key"), F.col("parts"))).drop("parts")


def str_order(x: np.ndarray, leaf: int, axes: list[int]) -> np.ndarray:
    """An order of the rows in which every `leaf` consecutive ones form a node."""
    def pack(at: np.ndarray, left: list[int]) -> np.ndarray:
        at = at[np.argsort(x[at, left[0]], kind="stable")]
        if len(left) == 1 or len(at) <= leaf:
            return at
        slabs = max(1, round((len(at) / leaf) ** (1 / len(left))))
        size = -(-len(at) // slabs)
        size += -size % leaf
        return np.concatenate([pack(at[k:k + size], left[1:]) for k in range(0, len(at), size)])

    return pack(np.arange(len(x)), axes) if len(x) else np.empty(0, np.int64)


def _boxes(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(x), size)
    return np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)


def _narrowest(x: np.ndarray) -> str:
    """The shortest whole numbers that hold the components; a reader knows them by the length of a tile."""
    most = np.abs(x).max(initial=0)
    return "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<i8"


def packed_tiles(rows: DataFrame, d: int, leaf: int = LEAF) -> DataFrame:
    """(tile, ids, labels, x, lo, hi): one written row a tile, its vectors in leaf order, with the tile's box."""

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["vec_id", "key"])
        x = _matrix(list(t["q"]), d)
        order = str_order(x, leaf, [int(c) for c in np.argsort(-x.var(0), kind="stable")[:3]])
        x = x[order]
        first = t.iloc[0]
        return pd.DataFrame([{"tile": f"{first['slab']}.{first['cell']}.{first['part']}", "ids": t["vec_id"].to_numpy()[order].tolist(), "labels": t["label"].to_numpy()[order].tolist(),
                              "x": x.astype(_narrowest(x)).tobytes(), "lo": x.min(0).tolist(), "hi": x.max(0).tolist()}])

    return written(rows.groupBy("slab", "cell", "part").applyInPandas(pack, "tile string, ids array<long>, labels array<long>, x binary, lo array<double>, hi array<double>"), "tiles")


def intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and highest inner product of each row of q with anything inside each box, widened by more than rounding can cost."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1e-6
    ends = up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack
    return tuple(np.clip(e, -2.0 ** 63, 2.0 ** 63) for e in ends)  # as scores saturate


def search_tile(q: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, least: np.ndarray, k: int, ids: np.ndarray, labels: np.ndarray,
                x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> list[tuple[int, int, int, bool]]:
    """(request, id, score, twin): each request's best k rows of one tile with scores inside [low, high] and not below `least`.

    Each request keeps a queue of inner nodes, the highest reachable score of their leaves first. The requests advance together,
    so those that open a node at the same step share one product; a request leaves when the next node is strictly below its kth.
    """
    most_s, most_id = -2 ** 63, 2 ** 63 - 1
    top = high.astype(float)[:, None]
    leaf_least, leaf_most = intervals(q, *_boxes(x, leaf))
    reach = np.where(leaf_least <= top, np.minimum(leaf_most, top), -np.inf)
    reach = np.maximum.reduceat(reach, np.arange(0, reach.shape[1], fan), axis=1)
    queue = np.argsort(-reach, axis=1, kind="stable")
    floats = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * q.shape[1] < _BIG
    bound = np.maximum(low.astype(float), least)
    score_, id_, at_ = np.full((len(q), k), most_s), np.full((len(q), k), most_id), np.full((len(q), k), -1)
    live = np.arange(len(q))
    for step in range(queue.shape[1]):
        live = live[reach[live, queue[live, step]] >= bound[live]]
        for m in np.unique(queue[live, step]):
            r = live[queue[live, step] == m]
            at = np.arange(m * leaf * fan, min((m + 1) * leaf * fan, len(x)))
            score = (q[r] @ x[at].T).astype(np.int64) if floats else np.stack([_exact(np.repeat(q[i:i + 1], len(at), 0), x[at]) for i in r])
            fits = ((labels[at] == label[r, None]) == same) & (score >= low[r, None]) & (score <= high[r, None]) & (score >= bound[r, None])
            some = fits.any(1)
            r, fits = r[some], fits[some]
            s = np.hstack((score_[r], np.where(fits, score[some], most_s)))
            i = np.hstack((id_[r], np.where(fits, ids[at], most_id)))
            p = np.hstack((at_[r], np.where(fits, at, -1)))
            best = np.lexsort((i, ~s), axis=-1)[:, :k]
            score_[r], id_[r], at_[r] = (np.take_along_axis(v, best, 1) for v in (s, i, p))
            kth = score_[r, k - 1].astype(float)
            kth = kth if floats else kth - np.abs(kth) * 1e-15
            bound[r] = np.where(at_[r, k - 1] >= 0, np.maximum(bound[r], kth), bound[r])
    a, b = np.nonzero(at_ >= 0)
    return [(int(r), int(id_[r, c]), int(score_[r, c]), bool((x[at_[r, c]] == q[r]).all())) for r, c in zip(a, b, strict=True)]


def search(requests: DataFrame, tiles: DataFrame, d: int, k: int, same: bool, directory: int = DIRECTORY, part: int = PART, leaf: int = LEAF) -> DataFrame:
    """(rid, vec_id, score, twin): the k best rows for each request (rid, q, label, low, high), ties to the smaller id.

    `same` asks for rows of the request's own label, else for rows of other labels. Two rounds: the most promising tile of each
    request, then all others that can still reach the kth score found there.
    """
    count = tiles.count()
    pages = max(1, -(-count // directory))
    boxes = (tiles.select("tile", "lo", "hi").withColumn("page", F.pmod(F.xxhash64("tile"), F.lit(pages)).cast("int")).groupBy("page")
             .agg(F.collect_list(F.struct("tile", "lo", "hi")).alias("boxes")))
    per_page = max(1, part)
    # one row a tile; left to the planner, the visits (a row for each request and tile) would be collected on the driver, as their file is small
    by_tile = lambda load: F.broadcast(load) if count <= BROADCAST_ROWS else load.hint("merge")

    def plan(asked: DataFrame, first_only: bool) -> DataFrame:
        """(rid, tile, most): the tiles a request may visit, from the directories in blocks of requests."""
        sent = asked.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).withColumn("deal", F.pmod(F.xxhash64("rid"), F.lit(4096)).cast("int"))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rid, tile, most_ = [], [], []
            if len(left) and len(right):
                box = right["boxes"].iloc[0]
                names = [b["tile"] for b in box]
                asked_ = left["rid"].tolist()
                lo, hi = _matrix([b["lo"] for b in box], d), _matrix([b["hi"] for b in box], d)
                for s in range(0, len(left), per_page):
                    some = left.iloc[s:s + per_page]
                    least, most = intervals(_matrix(list(some["q"]), d), lo, hi)
                    bound = np.maximum(some["low"].to_numpy(float), some["least"].to_numpy(float))
                    fits = (most >= bound[:, None]) & (least <= some["high"].to_numpy(float)[:, None])
                    reach = np.where(fits, np.minimum(most, some["high"].to_numpy(float)[:, None]), -np.inf)
                    if first_only:
                        a, b = np.arange(len(some)), reach.argmax(1)
                        ok = fits[a, b]
                        a, b = a[ok], b[ok]
                    else:
                        a, b = np.nonzero(fits)
                    rid += [asked_[s + k] for k in a.tolist()]
                    tile += [names[k] for k in b.tolist()]
                    most_ += reach[a, b].tolist()
            return pd.DataFrame({"rid": pd.Series(rid, dtype=object), "tile": pd.Series(tile, dtype=object), "most": np.array(most_, float)})

        # a directory meets the requests of one of its deals at a time; a deal is cut into blocks above
        deals = F.explode(F.sequence(F.lit(0), F.lit(4095)))
        few = asked.count()
        lots = max(1, min(4096, -(-few // (8 * per_page))))
        sent = sent.withColumn("deal", F.pmod("deal", F.lit(lots)))
        right = boxes.withColumn("deal", deals).where(F.col("deal") < lots)
        return sent.groupBy("page", "deal").cogroup(right.groupBy("page", "deal")).applyInPandas(meet, "rid string, tile string, most double")

    def visit(asked: DataFrame, which: DataFrame) -> DataFrame:
        load = by_tile(which.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts")))
        sent = (which.join(load, "tile").join(asked.hint("merge"), "rid").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
                .select("tile", "part", "rid", "q", "label", "low", "high", "least"))
        right = tiles.join(load, "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("tile", "part", "ids", "labels", "x")

        def meet(left: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            got = []
            if len(left) and len(held):
                row = held.iloc[0]
                x = np.frombuffer(row["x"], f"<i{len(row['x']) // (len(row['ids']) * d)}").reshape(-1, d).astype(float)
                got = search_tile(_matrix(list(left["q"]), d), left["label"].to_numpy(), same, left["low"].to_numpy(), left["high"].to_numpy(), left["least"].to_numpy(),
                                  k, np.asarray(row["ids"]), np.asarray(row["labels"]), x, leaf)
            rid = left["rid"].tolist()
            return pd.DataFrame({"rid": pd.Series([rid[g[0]] for g in got], dtype=object), "vec_id": np.array([g[1] for g in got], np.int64), "score": np.array([g[2] for g in got], np.int64),
                                 "twin": np.array([g[3] for g in got], bool)})

        return sent.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInPandas(meet, "rid string, vec_id long, score long, twin boolean")

    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id", F.desc("twin"))

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)

    asked = requests.withColumn("least", F.lit(float("-inf")))
    first = plan(asked, True)
    first = written(first.groupBy("rid").agg(F.max_by("tile", F.struct("most", "tile")).alias("tile")), "first-tiles")
    found = written(best(visit(asked, first)), "first-rows")
    if count <= 1:
        return found.drop("_n")
    low = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15
    least = found.where(F.col("_n") == k).select("rid", low.alias("least"))
    again = requests.join(least, "rid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = written(plan(again, False).join(first, ["rid", "tile"], "left_anti").select("rid", "tile"), "other-tiles")
    return written(best(visit(again, rest).unionByName(found.drop("_n"))).drop("_n"), "found")


def hard_negatives(vectors: DataFrame, is_anchor: Column, k: int = K, tile: int = TILE, leaf: int = LEAF, directory: int = DIRECTORY, part: int = PART) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows marked by a condition on vec_id."""
    rows = written(prepared(vectors), "vectors")
    copies = Window.partitionBy("label", "q").orderBy("vec_id")
    kept = rows.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k + 1).drop("c")
    facts = kept.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not facts["n"]:
        return rows.select(*[F.lit(0).cast("int" if c == "rank" else "long").alias(c) for c in names]).where("false")
    d = max(1, facts["d"] or 0)
    tiles = packed_tiles(tiled(kept, facts["n"], d, tile), d, leaf)

    anchors = rows.where(is_anchor)
    asked = anchors.groupBy("key").agg(F.first("q").alias("q"), F.first("label").alias("label"))  # a key stands for one label and vector
    near = search(asked.select(F.col("key").alias("rid"), "q", "label", F.lit(-_HUGE - 1).cast("long").alias("low"), F.lit(_HUGE).cast("long").alias("high")),
                  tiles, d, k + 1, True, directory, part, leaf)
    own = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "positive_id")
    positives = (anchors.select(F.col("vec_id").alias("anchor_id"), "key").join(near.select(F.col("rid").alias("key"), F.col("vec_id").alias("positive_id"), "score", "twin"), "key")
                 .where(~(F.col("twin") & (F.col("positive_id") == F.col("anchor_id")))).withColumn("n", F.row_number().over(own)).where(F.col("n") <= k))
    positives = written(positives.select("anchor_id", "key", "positive_id", F.col("score").alias("positive_score")), "positives")

    # for scores of zero and more the least whole number that is 80 / 100 of them or more
    low = F.col("positive_score") - F.expr("positive_score div 5")
    windows = positives.where("positive_score >= 0").select("key", "positive_score", F.concat_ws(":", "key", F.col("positive_score").cast("string")).alias("rid")).distinct()
    windows = windows.join(asked, "key").select("rid", "q", "label", low.alias("low"), F.col("positive_score").alias("high"))
    found = search(windows, tiles, d, k, False, directory, part, leaf)
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("rid", F.row_number().over(order).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.withColumn("rid", F.concat_ws(":", "key", F.col("positive_score").cast("string"))).join(ranked, "rid").select(*names)
