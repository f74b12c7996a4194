"""Best-fit packing after dominance reduction.

Documents become token pieces of at most `capacity`. Only lengths matter for packing, so the plan is made on the histogram
of piece lengths (at most `capacity` numbers, whatever the corpus size). Martello and Toth's dominance rules permanently fix
sets that some optimal packing contains: a piece nothing fits beside, a pair that fills a sequence exactly, a piece with its
largest partner where only one more piece fits, or where two fit but no two together beat that partner. Each fix shrinks the
instance and the rules run again. The remainder is packed best-fit decreasing, on groups of equal sequences. Pieces are
ranked inside their length by salted groups, and the plan maps a rank to a sequence and an offset.

Defined cases: null and empty texts give one piece holding only the end token; repeated rows are packed as rows of their own;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

CAPACITY = 1024
END_ID = 2
# Rows of one length that one salted group holds on average.
GROUP_ROWS = 100_000


class PieceTokenizer:
    """Ids of a byte-level BPE tokenizer file.

    Merging by rank gives the same ids where ids follow the order of the merges (checked on loading) and is several times
    faster. Texts that hold an added token, or characters that regex engines may class differently, take the slow way.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = re.compile(r"[^\t\n\r -~¡-ɏ‐-‧‰-⁞₠-₿]").search
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranked = None
        if all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
            # printable Latin-1 bytes stand for themselves in the file, the other bytes for the characters from 256 on
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
            ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
            self.ranked = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is None or any(a in text for a in self.added) or self.odd(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranked.encode_to_numpy(text, disallowed_special=())


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; only the first piece of a long document may be short."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for b in slices(batches):
            rows = []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(tok.ids(text), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(k, i, s, e - s, zlib.crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            at = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32)),
                                              *(pa.array(at[:, c]) for c in (2, 3, 4))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def dominance(counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Sets fixed by the dominance rules as (lengths, how often), and the counts that remain; counts[n] pieces have length n."""
    c = counts.astype(np.int64).copy()
    cap = len(c) - 1
    fixed: list[tuple[tuple[int, ...], int]] = []

    def largest(limit: int, taken: int) -> int:
        """The largest length up to `limit`, not counting one piece of length `taken`."""
        c[taken] -= 1
        found = np.flatnonzero(c[1:limit + 1]) + 1
        c[taken] += 1
        return int(found[-1]) if len(found) else 0

    def smallest(taken: int, how_many: int) -> list[int]:
        out: list[int] = []
        c[taken] -= 1
        for n in np.flatnonzero(c[1:]) + 1:
            out += [int(n)] * int(min(c[n], how_many - len(out)))
            if len(out) == how_many:
                break
        c[taken] += 1
        return out

    def two(limit: int, taken: int) -> int:
        """The largest sum of two further pieces within `limit`."""
        c[taken] -= 1
        have = np.flatnonzero(c[1:limit + 1]) + 1
        best = 0
        for n in have:
            rest = have[have <= limit - n]
            if len(rest) and rest[-1] == n and c[n] < 2:
                rest = rest[:-1]
            if len(rest):
                best = max(best, int(n + rest[-1]))
        c[taken] += 1
        return best

    changed = True
    while changed:
        changed = False
        for n in range(cap, 0, -1):
            while c[n]:
                small = smallest(n, 3)
                if not small or n + small[0] > cap:
                    partner = 0
                else:
                    partner = largest(cap - n, n)
                    only_one = len(small) < 2 or n + small[0] + small[1] > cap
                    at_most_two = len(small) < 3 or n + sum(small) > cap
                    if not (n + partner == cap or only_one or at_most_two and partner >= two(cap - n, n)):
                        break
                k = int(c[n]) if not partner else int(c[n] // 2) if partner == n else int(min(c[n], c[partner]))
                fixed.append(((n, partner) if partner else (n,), k))
                c[n] -= k
                if partner:
                    c[partner] -= k
                changed = True
    return fixed, c


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on groups of equal sequences: (lengths in order, how many sequences)."""
    cap = len(counts) - 1
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(cap, 0, -1):
        left = int(counts[n])
        while left:
            room = min((r for r in free if r >= n), default=None)
            if room is None:
                per = cap // n
                full, rest = divmod(left, per)
                for k, m in ((full, per), (1, rest)):
                    if k and m:
                        free.setdefault(cap - n * m, []).append(((n,) * m, k))
                left = 0
                continue
            lengths, k = free[room].pop()
            used = min(k, left)
            if used < k:
                free[room].append((lengths, k - used))
            if not free[room]:
                del free[room]
            free.setdefault(room - n, []).append(((*lengths, n), used))
            left -= used
    return [g for groups in free.values() for g in groups]


def plan(counts: np.ndarray) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, sequences, first sequence, offset) covering every rank of each length."""
    fixed, rest = dominance(counts)
    taken = np.zeros(len(counts), np.int64)
    rows, base = [], 0
    for lengths, k in [*fixed, *best_fit(rest)]:
        at, i = 0, 0
        while i < len(lengths):
            n, m = lengths[i], 1
            while i + m < len(lengths) and lengths[i + m] == n:
                m += 1
            rows.append((n, taken[n], m, k, base, at))
            taken[n] += m * k
            at += m * n
            i += m
        base += k
    assert (taken == counts).all()
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    n = pieces.count()
    salts = max(8, -(-n // GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
    rows = plan(hist)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (salted.withColumn("rank", F.row_number().over(order) - 1).join(before.select("length", "salt", "before"), ["length", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")))
    keys = rows[:, 0] * (1 << 48) + rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            p = rows[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            own = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(p[:, 4] + own // p[:, 2]),
                                              pa.array(p[:, 5] + own % p[:, 2] * length)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {dict(pieces.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
