"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Sketch. A document's distinct word shingles are thrown into `bins` bins, round after round with a fresh hash; a bin keeps
the smallest (round, hash) it saw. Rounds `bins`..2*`bins`-1 give every bin all shingles, so each coordinate fills. Filling
stops early, as later rounds never win over a filled bin. Coordinates agree with the chance of the Jaccard similarity.

Links. Documents with equal shingle sets collapse to one node first, so copies cost one row each. Bands of coordinates
give bucket keys. In each bucket all nodes are checked against the smallest one, on the full shingle sets; components
follow. Only buckets that still hold several components are compared further: block by block, across components only, on
full shingle sets, and one link for each node and foreign component is enough. No bucket is capped and no link between
different texts of a bucket is skipped; 42 bands of 6 coordinates miss a pair at similarity 0.8 three times in a million.

Defined cases: null or blank texts have an empty set, are linked with nothing and are their own component; fewer words than
a shingle make one shingle of the whole sequence; repeated rows give repeated result rows; rows that share an id keep their
own texts and share the smallest id as label. Rows without an id link like others and take the smallest id of their class; in
a class without any id the component is null and one text is kept. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import slices, written

BINS, ROWS = 256, 6
BLOCK = 256

_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word bytes to 64-bit hash, emptied when it grows past a million words."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ASCII letters are lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    k = min(size, n)
    s = np.full(n - k + 1, (k * int(_G)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(k):
        s = mix((s ^ h[i:n - k + 1 + i]) + _G)
    return np.unique(s)


_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _G)
_EMPTY = np.iinfo(np.uint64).max


def sketch(s: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch: for each bin the smallest (round, hash). `bins` is a power of two up to 256."""
    out = np.full(bins, _EMPTY, np.uint64)
    low, shift = np.uint64((1 << 54) - 1), np.uint64(64 - (bins.bit_length() - 1))
    at, step = 0, max(1, -(-2048 // len(s)))
    while at < bins and out.max() == _EMPTY:
        r = np.arange(at, min(bins, at + step))
        v = mix(s[None, :] ^ _SEEDS[r][:, None])
        np.minimum.at(out, (v >> shift).ravel().astype(np.int64), ((v & low) | (r.astype(np.uint64) << np.uint64(54))[:, None]).ravel())
        at += step
    for b in np.flatnonzero(out == _EMPTY):  # the rounds that offer every shingle to one bin
        v = mix(s ^ _SEEDS[bins + int(b)])
        out[b] = (v & low).min() | np.uint64((bins + int(b)) << 54)
    return out


def band_keys(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    g = sk[:len(sk) // rows * rows].reshape(-1, rows)
    k = np.arange(1, len(g) + 1, dtype=np.uint64) * _M2
    for i in range(rows):
        k = mix((k ^ g[:, i]) + _G)
    return k.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """(i, t, x): the id, a hash of the text, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("x"))


def node_of(i: str = "i", t: str = "t") -> Column:
    """A row's name: its id and text hash, ordered with null ids last, so that they never name a class that holds an id."""
    return F.struct(F.col(i).isNull().alias("z"), F.col(i).alias("i"), F.col(t).alias("t"))


def signatures(docs: DataFrame, size: int, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(i, t, n_shingles, set1, set2, bands) of every row; set1 and set2 digest the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, d1, d2, bands = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, size)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                d1.append(int.from_bytes(d[:8], "little", signed=True))
                d2.append(int.from_bytes(d[8:], "little", signed=True))
                bands.append(band_keys(sketch(s, bins), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], ["i", "t", "n_shingles", "set1", "set2", "bands"])

    return _keyed(docs).mapInArrow(run, "i long, t long, n_shingles long, set1 long, set2 long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, words) of the given nodes: the whole sorted shingle set."""
    texts = (_keyed(docs).withColumn("node", node_of()).join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("i", "t", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = pa.array([shingles(x, size).view(np.int64) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sets], ["i", "t", "words"])

    return texts.mapInArrow(run, "i long, t long, words array<long>").select(node_of().alias("node"), "words")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets reach the similarity: 100 * intersection >= percent * union."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
            .select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("c")))
    return both.where(F.col("c") * 100 >= percent * (F.col("n") + F.col("m") - F.col("c"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) between nodes of one bucket and different components, at least one for each node and component linked.

    A bucket of n nodes is dealt to ceil(n / BLOCK) blocks and each pair of blocks is compared in a group of its own.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    dealt = (members.join(sizes, "key").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
             .join(sets, "node").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("key", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "own", "node.i", "node.t",
                     F.col("label.i").alias("li"), F.col("label.t").alias("lt"), "words"))
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def compare(rows: list[tuple], sets_: list[np.ndarray]) -> list[tuple]:
        p, q = rows[0][1], rows[0][2]
        labels: dict = {}
        label = np.array([labels.setdefault(r[6:8], len(labels)) for r in rows])
        if len(labels) == 1:
            return []
        own = np.array([r[3] for r in rows])
        sizes_ = np.array([len(x) for x in sets_])
        codes = np.unique(np.concatenate(sets_), return_inverse=True)[1]
        starts = np.concatenate(([0], np.cumsum(sizes_)))
        flags = np.zeros(len(codes), np.int32)
        out = []
        for k in np.flatnonzero(own == p):
            other = (label != label[k]) & (own == q)
            if not other.any():
                continue
            mine = codes[starts[k]:starts[k + 1]]
            flags[mine] = 1
            common = np.add.reduceat(flags[codes], starts[:-1])
            flags[mine] = 0
            hit = np.flatnonzero(other & (100 * common >= percent * (sizes_ + sizes_[k] - common)))
            for m in hit[np.unique(label[hit], return_index=True)[1]]:
                out.append((*rows[k][4:6], *rows[m][4:6]))
        return out

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["i", "t", "j", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        held: list[np.ndarray] = []
        for b in slices(batches):
            out = []
            words = b.column(8)
            flat, at = words.values.to_numpy(), words.offsets.to_numpy()
            for k, r in enumerate(zip(*(b.column(c).to_pylist() for c in range(8)), strict=True)):
                if group and r[:3] != group[0][:3]:
                    out += compare(group, held)
                    group, held = [], []
                group.append(r)
                held.append(flat[at[k]:at[k + 1]])
            yield pack(out)
        if group:
            yield pack(compare(group, held))

    got = dealt.mapInArrow(run, "i long, t long, j long, u long")
    return got.select(node_of().alias("src"), node_of("j", "u").alias("dst")).distinct()


def classes(docs: DataFrame, size: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS, text_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`; with `text_hash` also t, a hash of the text."""
    sigs = written(signatures(docs, size, bins, rows).withColumn("node", node_of()).drop("i", "t"), "signatures")
    nodes = written(sigs.where("n_shingles > 0").groupBy("set1", "set2").agg(F.min("node").alias("node"), F.first("bands").alias("bands")), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    crowded = written(buckets.join(hubs, "key"), "buckets")
    sets = written(full_sets(docs, crowded.select("node").distinct(), size), "sets")
    star = crowded.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    edges = written(verified(star, sets, percent), "edges")
    label = components(edges)
    # buckets of several components: only their members are compared further
    named = written(crowded.select("key", "node").join(label.select(F.col("id").alias("node"), F.col("component").alias("c")), "node", "left")
                    .select("key", "node", F.coalesce("c", "node").alias("label")), "labelled")
    mixed = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    more = written(across(named.join(mixed, "key"), sets, percent), "more")
    final = components(edges.union(more))
    known = nodes.join(final.select(F.col("id").alias("node"), F.col("component").alias("c")), "node", "left").select("set1", "set2", F.coalesce("c", "node").alias("c"))
    out = sigs.select("node", "n_shingles", "set1", "set2").join(known, ["set1", "set2"], "left")
    out = out.withColumn("c", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("node")))
    kept = F.when(F.col("node.z"), F.col("node") == F.col("c")).otherwise(F.col("node.i").eqNullSafe(F.col("c.i")))
    return out.select(F.col("node.i").alias("doc_id"), "n_shingles", F.col("c.i").alias("component_id"), kept.alias("kept"), *([F.col("node.t").alias("t")] if text_hash else []))
