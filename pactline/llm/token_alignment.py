"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of linked id pairs.

Tokens of both tokenizers become Arrow lists. Flattened lists, parent indices and segmented cumulative sums of the tokens' byte
lengths give each token's end inside its document; an Acero hash join on (document, end) finds the ends that both share. These
ends cut the documents into groups, and all pairs of A and B tokens of one group are links. `Table.group_by` counts, for a block
of documents of bounded size, how many documents hold a pair; Spark adds the partial counts up. Looked-up counts come back once
for each block and pair, not for each document, and meet the documents of their block, which carry their links as positions in
the block's list of pairs. One written table holds documents and blocks, so a lost executor costs no second tokenisation.

Wide groups are reduced to distinct ids with multiplicities before pairs are formed, so a group never gives more pairs than
distinct ids of A times distinct ids of B.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space+text under either tokenizer, have no
tokens: all figures are zero and the groups empty; strings of special tokens are plain text; rows that repeat, or share an id,
are documents of their own and each counts; a null id is kept as it is; an empty table gives an empty result; texts of any
length are encoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best_fit_packing import PieceTokenizer
from .common import slices, written

# Tokens of A after which a block of documents is closed, and text bytes aligned at a time.
BLOCK_TOKENS = 2_000_000
STEP_BYTES = 1_000_000
# A group with more links than this is reduced to distinct ids first.
WIDE = 256


class ByteTokens:
    """Ids and token bytes of the byte-level tokenizer A."""

    def __init__(self, path: str):
        self.pieces = PieceTokenizer(path)
        self.pieces.tok.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        vocabulary = self.pieces.tok.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.table = pa.array(table, pa.binary())

    def ids(self, text: str) -> np.ndarray:
        if self.pieces.ranked is None or self.pieces.odd(text):
            return np.array(self.pieces.tok.encode(text, add_special_tokens=False).ids, np.int32)
        return self.pieces.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class PieceTokens:
    """Ids and token bytes of the sentencepiece tokenizer B."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        table = []
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            table.append(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode())
        self.table = pa.array(table, pa.binary())

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)


class Aligner:
    """Aligns batches of texts under two tokenizers; one for each worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        marks = ",|;"
        size = max(len(self.a.table), len(self.b.table))
        self.written = pa.array([f"{i}{m}" for i in range(size) for m in marks], pa.binary())

    def align(self, texts: list[str | None]) -> Batch:
        lists_a, lists_b = [], []
        none = np.empty(0, np.int32)
        for x in texts:
            ia, ib = (self.a.ids(" " + x), self.b.ids(x)) if x else (none, none)
            if x:
                want = b" " + x.encode("utf-8", "surrogatepass")
                if _joined(self.a.table, ia) != want or _joined(self.b.table, ib) != want:
                    ia = ib = none
            lists_a.append(ia)
            lists_b.append(ib)
        return Batch(self, _lists(lists_a), _lists(lists_b))


def _joined(table: pa.Array, ids: np.ndarray) -> bytes:
    return b"".join(table.take(pa.array(ids)).to_pylist()) if len(ids) < 64 else _flat(table.take(pa.array(ids)))


def _flat(tokens: pa.Array) -> bytes:
    """The bytes of a freshly taken binary array, joined."""
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1]
    return memoryview(tokens.buffers()[2])[offsets[0]:offsets[-1]].tobytes()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))


def _ends(lists: pa.ListArray, table: pa.Array) -> pa.Table:
    """One row a token: document (parent index), byte end inside the document, place among all tokens, id."""
    ids, doc = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int32())
    total = pc.cumulative_sum(pc.cast(pc.take(pc.binary_length(table), ids), pa.int64())).to_numpy(zero_copy_only=False)
    starts = np.asarray(lists.offsets)[:-1]
    base = np.concatenate(([0], total))[starts] if len(starts) else np.empty(0, np.int64)
    end = total - base[doc.to_numpy()]
    return pa.table({"doc": doc, "end": end, "at": np.arange(len(ids)), "id": ids})


class Batch:
    """Aligned documents: groups, figures of each document and its distinct links."""

    def __init__(self, owner: Aligner, lists_a: pa.ListArray, lists_b: pa.ListArray):
        self.owner, self.n = owner, len(lists_a)
        a, b = _ends(lists_a, owner.a.table), _ends(lists_b, owner.b.table)
        shared = a.select(["doc", "end", "at"]).join(b.select(["doc", "end", "at"]), ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
        self.group_a, self.group_b = (self._groups(len(t), shared[c].to_numpy()) for t, c in ((a, "at"), (b, "at_b")))
        self.id_a, self.id_b = a["id"].to_numpy(), b["id"].to_numpy()
        self.doc_a, self.doc_b = a["doc"].to_numpy(), b["doc"].to_numpy()
        groups = len(shared)
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.doc_of_group = np.zeros(groups, np.int32)
        self.doc_of_group[self.group_a] = self.doc_a
        self.n_a, self.n_b = np.bincount(self.doc_a, minlength=self.n), np.bincount(self.doc_b, minlength=self.n)
        self.n_groups = np.bincount(self.doc_of_group, minlength=self.n)
        self.n_links = np.zeros(self.n, np.int64)
        np.add.at(self.n_links, self.doc_of_group, self.size_a.astype(np.int64) * self.size_b)

    @staticmethod
    def _groups(tokens: int, closing: np.ndarray) -> np.ndarray:
        """Each token's group: how many groups were closed before it."""
        closes = np.zeros(tokens + 1, np.int64)
        closes[closing + 1] = 1
        return np.cumsum(closes)[:-1]

    def spelled(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of every document."""
        after_a, after_b = np.cumsum(self.size_a), np.cumsum(self.size_b)
        at_a = np.arange(len(self.id_a)) + (after_b - self.size_b)[self.group_a]
        at_b = np.arange(len(self.id_b)) + after_a[self.group_b]
        last_a = np.arange(len(self.id_a)) == after_a[self.group_a] - 1
        last_b = np.arange(len(self.id_b)) == after_b[self.group_b] - 1
        code = np.empty(len(self.id_a) + len(self.id_b), np.int64)
        code[at_a], code[at_b] = self.id_a * 3 + last_a, self.id_b * 3 + 2 * last_b
        tokens = self.owner.written.take(pa.array(code))
        offsets = np.frombuffer(tokens.buffers()[1], np.int32) if len(code) else np.zeros(1, np.int32)
        data = memoryview(tokens.buffers()[2]) if len(code) else memoryview(b"")
        cuts = offsets[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        return [bytes(data[s:e - 1]) if e > s else b"" for s, e in zip(cuts, cuts[1:], strict=False)]

    def links(self) -> pa.Table:
        """(doc, pair, m): the distinct pairs of each document and how many links have them; pair is A's id * 2**32 + B's id."""
        links = self.size_a.astype(np.int64) * self.size_b
        wide = links > WIDE
        parts = [self._crossed(~wide, self.size_a, self.size_b, self.id_a, self.id_b, self.group_a, self.group_b)]
        if wide.any():
            pick_a, pick_b = wide[self.group_a], wide[self.group_b]
            ga, xa, ma = self._distinct(self.group_a[pick_a], self.id_a[pick_a])
            gb, xb, mb = self._distinct(self.group_b[pick_b], self.id_b[pick_b])
            size_a, size_b = np.bincount(ga, minlength=len(wide)), np.bincount(gb, minlength=len(wide))
            parts.append(self._crossed(wide, size_a, size_b, xa, xb, ga, gb, ma, mb))
        rows = pa.concat_tables(parts)
        return rows.group_by(["doc", "pair"], use_threads=False).aggregate([("m", "sum")]).rename_columns(["doc", "pair", "m"])

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, m = np.unique(group.astype(np.int64) << 32 | ids, return_counts=True)
        return key >> 32, (key & 0xFFFFFFFF).astype(np.int32), m

    def _crossed(self, chosen: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, id_a: np.ndarray, id_b: np.ndarray, group_a: np.ndarray,
                 group_b: np.ndarray, m_a: np.ndarray | None = None, m_b: np.ndarray | None = None) -> pa.Table:
        """The pairs inside each chosen group; tokens stand in group order."""
        keep = np.flatnonzero(chosen[group_a])
        times = size_b[group_a[keep]]
        left = np.repeat(keep, times)
        first_b = (np.cumsum(size_b) - size_b)[group_a[keep]]
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b, times)
        m = np.ones(len(left), np.int64) if m_a is None else m_a[left] * m_b[right]
        return pa.table({"doc": self.doc_of_group[group_a[left]], "pair": id_a[left].astype(np.int64) << 32 | id_b[right], "m": m})


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


class _Block:
    """Documents of one block until it is closed: their ids, figures and links."""

    def __init__(self) -> None:
        self.tokens, self.ids, self.figures, self.sums, self.texts, self.links, self.n = 0, [], [], [], [], [], 0

    def add(self, ids: pa.Array, batch: Batch, spell: bool) -> None:
        groups = batch.spelled()
        self.ids.append(ids)
        self.figures.append(np.stack([batch.n_a, batch.n_b, batch.n_groups, batch.n_links], 1).astype(np.int64))
        self.sums += [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
        self.texts += [g.decode() if spell else None for g in groups]
        t = batch.links()
        self.links.append((t["doc"].to_numpy() + self.n, t["pair"].to_numpy(), t["m"].to_numpy()))
        self.n += batch.n
        self.tokens += int(batch.n_a.sum())

    def rows(self, number: int, names: list[str]) -> pa.RecordBatch:
        """One row a document, whose links are positions in the pair list of the last row, which stands for the block."""
        doc, pair, m = (np.concatenate(x) for x in zip(*self.links, strict=True))
        pairs, at = np.unique(pair, return_inverse=True)
        counts = pa.table({"at": at}).group_by("at", use_threads=False).aggregate([("at", "count")])
        n_docs = np.zeros(len(pairs), np.int32)
        n_docs[counts["at"].to_numpy()] = counts["at_count"].to_numpy()
        order = np.lexsort((at, doc))
        doc, at, m = doc[order], at[order], m[order]
        cuts = np.searchsorted(doc, np.arange(self.n + 1))
        codec = pa.Codec("zstd", 1)
        packed = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            steps = np.diff(at[s:e], prepend=0).astype("<u4").tobytes() + m[s:e].astype("<u8").tobytes()
            packed.append(codec.compress(steps, asbytes=True) if e > s else b"")
        figures = np.concatenate(self.figures)
        more = lambda values, kind: pa.array([*values, None], kind)
        ids = pa.concat_arrays([*self.ids, pa.nulls(1, self.ids[0].type)])
        no_list = [None] * self.n
        columns = [pa.array([number] * (self.n + 1), pa.int64()), pa.array([False] * self.n + [True]), ids, *(more(figures[:, k].tolist(), pa.int64()) for k in range(4)),
                   more(self.sums, pa.string()), more(self.texts, pa.string()), more([int(e - s) for s, e in zip(cuts, cuts[1:], strict=False)], pa.int32()),
                   more(packed, pa.binary()), pa.array([*no_list, pairs], pa.list_(pa.int64())), pa.array([*no_list, n_docs], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, spell: bool = False, block_tokens: int = BLOCK_TOKENS, step_bytes: int = STEP_BYTES) -> DataFrame:
    """Documents and blocks of documents (`is_block`), written: figures and packed links of the former, pair lists of the latter."""
    src = docs.select("doc_id", F.col("text").alias("x"))
    kind = dict(src.dtypes)["doc_id"]
    names = ["block", "is_block", "doc_id", *_FIGURES, "groups_sha256", "groups", "n_pairs", "links", "pairs", "n_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            lo = held = 0
            for k, x in enumerate(texts):
                held += len(x or "")
                if held >= step_bytes or k + 1 == len(texts):
                    block.add(b.column(0).slice(lo, k + 1 - lo), own.align(texts[lo:k + 1]), spell)
                    lo, held = k + 1, 0
                    if block.tokens >= block_tokens:
                        yield block.rows(number, names)
                        number, block = number + 1, _Block()
        if block.n:
            yield block.rows(number, names)

    schema = (f"block long, is_block boolean, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
              "n_pairs int, links binary, pairs array<long>, n_docs array<int>")
    return written(src.mapInArrow(run, schema), "alignment")


def _partial_counts(blocks: DataFrame) -> DataFrame:
    return blocks.where("is_block").select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether that is the most of any pair of its A id."""
    n = _partial_counts(blocks).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    n = written(n, "pair-counts")
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, spell: bool = False, block_tokens: int = BLOCK_TOKENS, step_bytes: int = STEP_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every row of `docs`."""
    blocks = aligned_blocks(docs, path_a, path_b, spell, block_tokens, step_bytes)
    known = _partial_counts(blocks).select("block", "at", "pair").join(pair_counts(blocks), "pair").select(F.col("block").alias("of_block"), "at", "n", "best")
    keep = ["doc_id", *_FIGURES, "groups_sha256", *(["groups"] if spell else [])]
    rows = blocks.where("not is_block").select("block", *keep, "n_pairs", "links")
    kinds = dict(rows.dtypes)
    columns = ["doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256", *(["groups"] if spell else [])]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["at"].to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
        codec = pa.Codec("zstd", 1)
        n_best, count_sum = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for k, (size, links) in enumerate(zip(left["n_pairs"].to_pylist(), left["links"], strict=True)):
            if size:
                raw = codec.decompress(links.as_buffer(), 12 * size)
                where = np.cumsum(np.frombuffer(raw, "<u4", size), dtype=np.int64)
                m = np.frombuffer(raw, "<u8", size, 4 * size).astype(np.int64)
                n_best[k], count_sum[k] = (best[where] * m).sum(), (n[where] * m).sum()
        out = left.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
        return out.select(columns)

    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns)
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(meet, schema)
