"""Token counts by a deterministic transducer compiled from a piece vocabulary.

The model merges adjacent symbols whose joined text is a piece, best score first. For such models the encoding of a prefix
ends in the one piece t for which the encoding of what precedes t ends in a piece that stays apart from t. So the state after
a prefix needs, for every suffix that still starts some piece, the last piece before that suffix and the tokens since then:
finitely many. Runs of the space mark merge last and from the left, so a run needs its length modulo the longest run piece.
States and transitions are compiled when first met and then kept; a transition carries the change of the token count.

A text is cut into chunks. A chunk's state map sends any entry state through the text before its first reset (a space mark
after another character), adds the constant count of its inner segments and leaves in the constant state after its last
character. Maps compose associatively; a parallel prefix scan over the chunk maps gives the count of every prefix.

Defined cases: null and empty texts have no tokens; characters outside the vocabulary count their UTF-8 bytes; repeated rows
give repeated results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
CHUNK = 65_536
LIMIT = 4_096
_RESET = re.compile(f"(?<=[^{MARK}]){MARK}")


class Transducer:
    """States are numbers; the space mark is part of the alphabet."""

    def __init__(self, pieces: dict[str, float], runs: set[str] = frozenset()):
        self.pieces = pieces
        self.longest = longest_run = max(map(len, runs), default=1)
        # tokens of a run of k marks: all run pieces rank equal, so the leftmost join comes first; the table repeats, one
        # token more for each longest piece
        self.run_tokens = [len(self._merge_run(k, {len(r) for r in runs})) for k in range(3 * longest_run + 1)]
        if any(self.run_tokens[k + longest_run] != self.run_tokens[k] + 1 for k in range(2 * longest_run + 1)):
            raise ValueError("runs of the mark do not repeat")
        self.starts = {p[:k] for p in pieces for k in range(1, len(p))}
        self.apart: dict[tuple[str, str], bool] = {}
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.fresh = self._number((("", "", 0),))
        self.runs = [self._number(("run", k)) for k in range(1, longest_run + 1)]
        self.words = _Segments(self)

    @classmethod
    def from_model(cls, path: str) -> Transducer:
        """Read a sentencepiece model whose pieces hold the mark only in front and whose normaliser leaves text as it is."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in usual}
        runs = {p for p in pieces if len(p) > 1 and not p.strip(MARK)}
        least = min(s for p, s in pieces.items() if p not in runs and len(p) > 1)
        if (any(MARK in p[1:] for p in pieces if p not in runs) or len({pieces[r] for r in runs}) > 1 or any(pieces[r] >= least for r in runs)
                or sp.normalize(" a  b") != f"{MARK}{MARK}a{MARK}{MARK}b"):
            raise ValueError(f"this model needs other states: {path}")
        return cls({p: s for p, s in pieces.items() if p not in runs}, runs)

    @staticmethod
    def _merge_run(k: int, lengths: set[int]) -> list[int]:
        s = [1] * k
        while True:
            i = next((i for i in range(len(s) - 1) if s[i] + s[i + 1] in lengths), None)
            if i is None:
                return s
            s[i:i + 2] = [s[i] + s[i + 1]]

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def merge(self, text: str) -> list[str]:
        """The model's own procedure on a short text: join the best-scored neighbours, leftmost first, until none is left."""
        s = list(text)
        while True:
            joins = [(self.pieces[a + b], -i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in self.pieces]
            if not joins:
                return s
            i = -max(joins)[1]
            s[i:i + 2] = [s[i] + s[i + 1]]

    def _stays(self, left: str, right: str) -> bool:
        got = self.apart.get((left, right))
        if got is None:
            got = self.apart[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return got

    def step(self, state: int, c: str) -> tuple[int, int]:
        """(next state, change of the token count), compiled once for each state and character."""
        got = self.steps[state].get(c)
        if got is None:
            got = self.steps[state][c] = self._compile(self.states[state], c)
        return got

    def _compile(self, old: tuple, c: str) -> tuple[int, int]:
        run = old[1] if old[0] == "run" else 0
        if c == MARK:
            return self.runs[run % self.longest], self.run_tokens[run + 1] - self.run_tokens[run]
        if c not in self.pieces:
            return self.fresh, len(c.encode("utf-8", "replace"))
        if run:
            # the last mark may join the word; while it stays alone it belongs to the run
            old = ((MARK, "", self.run_tokens[run] - self.run_tokens[run - 1]), ("", MARK, 0))
        last, since = next((s + c, n) for s, before, n in old if s + c in self.pieces and self._stays(before, s + c))
        change = 1 - since
        return self._number((*[(s + c, before, n + change) for s, before, n in old if s + c in self.starts], ("", last, 0))), change

    def walk(self, state: int, text: str) -> tuple[int, int]:
        total = 0
        for c in text:
            state, n = self.step(state, c)
            total += n
        return state, total

    def segments(self, text: str) -> int:
        """Tokens of a text that starts with a mark, counted by the segments between resets."""
        words = text[1:].split(MARK)
        if "" not in words:
            return sum(map(self.words.__getitem__, words))
        total = run = 0
        for w in words:
            run += 1
            if w:
                short = (run - 1) % self.longest + 1
                total += (run - short) // self.longest
                total += self.words[w] if short == 1 else self.run_tokens[short] + self.walk(self.runs[short - 1], w)[1]
                run = 0
        return total + run // self.longest + self.run_tokens[run % self.longest]


class _Segments(dict):
    """Tokens of mark + word, kept for words already met and emptied when it grows past a bound."""

    def __init__(self, t: Transducer, limit: int = 500_000):
        super().__init__()
        self.t, self.limit = t, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[word] = 1 + self.t.walk(self.t.runs[0], word)[1]
        return n


@dataclass(frozen=True)
class ChunkMap:
    """head is read from the entry state; after a reset `inner` tokens and the exit state no longer depend on it."""

    head: str
    inner: int = 0
    exit: int = -1  # -1: no reset inside, the exit state follows from the entry state


def chunk_map(t: Transducer, chunk: str) -> ChunkMap:
    m = _RESET.search(chunk)
    if not m:
        return ChunkMap(chunk)
    last = chunk.rfind(MARK)
    while last and chunk[last - 1] == MARK:
        last -= 1
    exit_, n = t.walk(t.fresh, chunk[last:])
    inner = t.segments(chunk[m.start():last]) if last > m.start() else 0
    return ChunkMap(chunk[:m.start()], inner + n, exit_)


def compose(t: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of a's text followed by b's."""
    if a.exit < 0:
        return ChunkMap(a.head + b.head, b.inner, b.exit)
    state, n = t.walk(a.exit, b.head)
    return ChunkMap(a.head, a.inner + n + b.inner, state if b.exit < 0 else b.exit)


def prefix_scan(t: Transducer, maps: list[ChunkMap]) -> list[ChunkMap]:
    """Inclusive scan in log2(n) rounds; the compositions of one round are independent of each other."""
    d = 1
    while d < len(maps):
        maps = [m if i < d else compose(t, maps[i - d], m) for i, m in enumerate(maps)]
        d *= 2
    return maps


def count_tokens(t: Transducer, text: str | None, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    s = MARK + text.replace(" ", MARK)
    if len(s) <= chunk:
        return t.segments(s)
    whole = prefix_scan(t, [chunk_map(t, s[i:i + chunk]) for i in range(0, len(s), chunk)])[-1]
    return t.walk(t.fresh, whole.head)[1] + whole.inner


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for each worker; it starts anew when very many states have been compiled."""
    if path not in _COMPILED or len(_COMPILED[path].states) > 250_000:
        _COMPILED[path] = Transducer.from_model(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    src = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in slices(batches):
            n = np.array([count_tokens(t, x, chunk) for x in b.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
