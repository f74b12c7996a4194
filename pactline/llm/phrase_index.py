"""Benchmark decontamination on a distributed positional inverted index.

The benchmark is read in blocks of bounded size. For a block, one pass over the corpus counts its terms; each window of
`width` item words is then represented by its two rarest terms. A second pass stores the corpus postings (term, document,
positions) of exactly those terms, together with the length of every document. Postings of the rarest term give candidate
alignments (item, document position - item position); they are intersected with the offset-adjusted postings of the second
rarest; what survives is compared word by word along the alignment, which also finds the remaining windows of the match.

`proximity` answers queries of several terms within a slop from the same kind of postings, again from the rarest term.

Defined cases: null and wordless texts have no words, are never hit and never match; an item shorter than the width is one
window; items or documents that share an id keep their own texts, an item id counts once; repeated rows give repeated
results; rows without an id are matched like any other; an empty benchmark or corpus is no error; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, written

WIDTH = 13
# Words of benchmark text handled at once; more are handled block after block, so what is sent to tasks stays bounded.
BLOCK_WORDS = 400_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII digits, letters (lower-cased) and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


@dataclass
class Block:
    """Some benchmark items as term numbers."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    ids: list = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)

    def add(self, item_id, text: str | None) -> None:
        w = words(text)
        if w and item_id is not None:
            self.ids.append(item_id)
            self.items.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int32))

    def numbers(self, w: list[bytes]) -> np.ndarray:
        """Term numbers of a text; words that the block lacks get the number after the last."""
        none = len(self.vocabulary)
        get = self.vocabulary.get
        return np.fromiter((get(x, none) for x in w), np.int32, len(w))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name where a null id equals a null id; the right side's own copies of them are dropped."""
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    out = left.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on)), how)
    return out if how == "left_semi" else out.drop(*(f"_right_{c}" for c in on))


def _corpus(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("x"))


def term_counts(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each term of the block stands in the corpus; one number per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.vocabulary) + 1, np.int64)
        for b in slices(batches):
            for x in b.column(0).to_pylist():
                total += np.bincount(block.numbers(words(x)), minlength=len(total))
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    got = _corpus(docs).select("x").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(block.vocabulary), np.int64)
    out[got["term"].to_numpy(int)] = got["n"].to_numpy(int)
    return out


def rare_pairs(item: np.ndarray, counts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Positions of the rarest and the second rarest term of each window, each distinct pair once."""
    n = min(width, len(item))
    view = np.lib.stride_tricks.sliding_window_view(counts[item], n)
    order = np.argsort(view, axis=1, kind="stable")[:, :2] + np.arange(len(view))[:, None]
    return sorted({(int(r[0]), int(r[-1])) for r in order})


def postings(docs: DataFrame, block: Block, terms: np.ndarray) -> DataFrame:
    """The stored index: (doc_id, t, term, positions) for the given terms, and per document a row of term -1 with its length."""
    wanted = np.zeros(len(block.vocabulary) + 1, bool)
    wanted[terms] = True
    src = _corpus(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, term, where = [], [], []
            for k, x in enumerate(b.column(2).to_pylist()):
                n = block.numbers(words(x))
                at = np.flatnonzero(wanted[n])
                doc.append(k)
                term.append(-1)
                where.append(np.array([len(n)], np.int32))
                if len(at):
                    at = at[np.argsort(n[at], kind="stable")]
                    cuts = np.flatnonzero(np.diff(n[at])) + 1
                    for part in np.split(at, cuts):
                        doc.append(k)
                        term.append(int(n[part[0]]))
                        where.append(part.astype(np.int32))
            rows = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(term, pa.int32()),
                                              pa.array(where, pa.list_(pa.int32()))], ["doc_id", "t", "term", "positions"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, t long, term int, positions array<int>")


def alignments(index: DataFrame, block: Block, pairs: list[list[tuple[int, int]]]) -> DataFrame:
    """(doc_id, t, item, shift) where the two rarest terms of some window stand at their offsets; shift = document - item position."""
    spark = index.sparkSession
    rows = [(k, int(item[p]), p, int(item[q]), q) for k, (item, pq) in enumerate(zip(block.items, pairs, strict=True)) for p, q in pq]
    # no more rows than benchmark words in a block, so the broadcasts are bounded
    windows = F.broadcast(spark.createDataFrame(rows, "item int, rarest int, p int, second int, q int"))
    hits = index.where("term >= 0").select("doc_id", "t", "term", F.explode("positions").alias("pos"))
    first = (hits.join(windows, F.col("term") == F.col("rarest"))
             .select("doc_id", "t", "item", (F.col("pos") - F.col("p")).alias("shift"), "p", "second", "q"))
    done = first.where("p = q").select("doc_id", "t", "item", "shift")  # windows of one word
    second = first.where("p <> q").select("doc_id", "t", "item", "shift", "second", (F.col("shift") + F.col("q")).alias("pos")).distinct()
    both = joined(second, hits.withColumnRenamed("term", "second"), ["doc_id", "t", "second", "pos"], "left_semi").select("doc_id", "t", "item", "shift")
    return done.union(both).distinct()


def exact_matches(docs: DataFrame, found: DataFrame, block: Block, width: int) -> DataFrame:
    """(doc_id, t, item_ids, hits): items with whole windows in the document and the document positions inside them."""
    per_doc = found.groupBy("doc_id", "t").agg(F.collect_list(F.struct("item", "shift")).alias("found"))
    src = joined(_corpus(docs).dropDuplicates(["doc_id", "t"]), per_doc, ["doc_id", "t"]).select("doc_id", "t", "x", "found.item", "found.shift")
    kinds = dict(src.dtypes)

    def match(n: np.ndarray, item: np.ndarray, shift: int, hit: np.ndarray) -> bool:
        w = min(width, len(item))
        lo, hi = max(0, shift), min(len(n), shift + len(item))
        if hi - lo < w:
            return False
        run = np.concatenate(([0], np.cumsum(n[lo:hi] == item[lo - shift:hi - shift])))
        at = np.flatnonzero(run[w:] - run[:-w] == w) + lo
        for s in at:
            hit[s:s + w] = True
        return len(at) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, hits = [], []
            for x, items, shifts in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                n = block.numbers(words(x))
                hit = np.zeros(len(n), bool)
                got = {k for k, s in zip(items, shifts, strict=True) if match(n, block.items[k], s, hit)}
                ids.append(sorted({str(block.ids[k]) for k in got}))
                hits.append(np.flatnonzero(hit).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int32()))],
                                             ["doc_id", "t", "item_ids", "hits"])

    return src.mapInArrow(run, f"doc_id {kinds['doc_id']}, t long, item_ids array<string>, hits array<int>")


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about `block_words` words each, dealt by a hash of the item."""
    sized = items.select("item_id", "text", F.octet_length("text").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total) // (3 * block_words)))
    for k in range(parts):
        block = Block()
        for r in sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).select("item_id", "text").distinct().toLocalIterator():
            block.add(r["item_id"], r["text"])
        yield block


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, t, n_words, n_hit, item_ids) for every row of `docs`; t is a hash of the text, item_ids are strings in order."""
    lengths, found = None, []
    for block in blocks(items, block_words):
        counts = term_counts(docs, block) if block.items else np.zeros(0, np.int64)
        pairs = [rare_pairs(item, counts, width) for item in block.items]
        terms = np.unique(np.array([item[p] for item, pq in zip(block.items, pairs, strict=True) for two in pq for p in two], np.int64))
        index = written(postings(docs, block, terms), "postings")
        if lengths is None:
            lengths = index.where("term = -1").select("doc_id", "t", F.col("positions")[0].cast("long").alias("n_words"))
        if block.items:
            found.append(written(exact_matches(docs, alignments(index, block, pairs), block, width), "matches"))
    hits = None
    for f in found:
        hits = f if hits is None else hits.union(f)
    if hits is None:
        return lengths.select("doc_id", "t", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    if len(found) > 1:
        hits = hits.groupBy("doc_id", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
                                               F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    none = F.array().cast("array<string>")
    return joined(lengths, hits, ["doc_id", "t"], "left").select(
        "doc_id", "t", "n_words", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """At least one word in twenty lies inside benchmark windows."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def proximity(spark: SparkSession, docs: DataFrame, queries: dict[str, list[str]], slop: int) -> DataFrame:
    """(query, doc_id, pos): positions of a query's rarest term with all its other terms within `slop` words."""
    block = Block()
    for name, terms in queries.items():
        block.add(name, " ".join(terms))
    counts = term_counts(docs, block)
    index = written(postings(docs, block, np.arange(len(block.vocabulary))), "postings")
    rows = []
    for name, item in zip(block.ids, block.items, strict=True):
        order = sorted(Counter(item.tolist()), key=lambda k: (counts[k], k))
        rows += [(name, order[0], t, len(order)) for t in order]
    asked = F.broadcast(spark.createDataFrame(rows, "query string, rarest int, term int, n int"))
    hits = index.where("term >= 0").select("doc_id", "t", "term", F.explode("positions").alias("pos")).join(asked, "term")
    anchors = hits.where("term = rarest").select("query", "doc_id", "t", F.col("pos").alias("at"), "n")
    # positions meet in stretches of slop + 1 words: an anchor looks into its own stretch and both beside it
    stretch = lambda c: F.floor(F.col(c) / (slop + 1))
    beside = anchors.withColumn("s", F.explode(F.array(stretch("at") - 1, stretch("at"), stretch("at") + 1)))
    near = joined(beside, hits.select("query", "doc_id", "t", "term", "pos", stretch("pos").alias("s")), ["query", "doc_id", "t", "s"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    return (near.groupBy("query", "doc_id", "t", "at", "n").agg(F.countDistinct("term").alias("got")).where("got = n")
            .select("query", "doc_id", F.col("at").alias("pos")))
