"""Toxicity of deobfuscated text.

Noisy channel. A character model (4-grams over letters, digits and breaks) is counted over the whole corpus. A token that
mixes letters with look-alike digits or signs, repeats a letter three times or more, or holds separators between letters becomes
a lattice, and so does a row of three or more single letters, digits or look-alike signs parted by separators or white space:
each look-alike may stand for itself or its letters, a run of one letter for one, two or all of its letters, a run of separators
or white space for a break or nothing. Viterbi decoding under the character model picks the restored form.

Scoring. Words of the restored text and their prefixes carry log-odds of toxic documents, lowered by their standard error, so
rare features count little. The strongest feature of each distinct word is its evidence; a logistic model on the summary of a
document's evidence gives the score, shifted so that the best cut on the training rows lands on 0.7. No feature is
left out for being rare.

Defined cases: null and empty texts are scored as texts without words; without labels of both classes every document gets the
share of label 1 (0.5 without labels), and 0.7 times that share when no feature points to toxic texts; null labels are left out;
repeated rows give repeated results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, written
from .quality_ranking import quantile_cut

# Bound on the labelled rows; the features that reach the driver come from their texts alone.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7

# What look-alike characters may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = ".-_*"
SUBSTITUTE, COLLAPSE, DROP = 1.0, 0.5, 0.7

# Model alphabet: 0 break, 1..26 letters without accents, 27 digit.
SIZE = 28
_BASE = dict(zip("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿß", "aaaaaaceeeeiiiinoooooouuuuyys", strict=True))
_CODES = np.zeros(256, np.int64)
for _c in range(256):
    _l = chr(_c).lower()
    _l = _BASE.get(_l, _l)
    _CODES[_c] = ord(_l) - 96 if "a" <= _l <= "z" else 27 if _l.isdigit() and _l.isascii() else 0


def _codes(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("latin-1", "replace").replace(b"?", b" "), np.uint8)]


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """4-gram counts over all documents; at most SIZE**4 numbers reach the driver, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 4, np.int64)
        for b in slices(batches):
            c = _codes("   " + "   ".join(b.column(0).to_pylist()) + " ")
            total += np.bincount(((c[:-3] * SIZE + c[1:-2]) * SIZE + c[2:-1]) * SIZE + c[3:], minlength=SIZE ** 4)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    src = docs.select(F.coalesce(text, F.lit("")).alias("x"))
    got = src.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE ** 4)
    out[got["k"].to_numpy(int)] = got["n"].to_numpy(float)
    return out


def character_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """-log P(next | three before), each order smoothed by the next lower one."""
    c = counts.reshape((SIZE,) * 4)
    p = np.full(SIZE, 1.0 / SIZE)
    for order in range(4):
        n = c.sum(axis=tuple(range(3 - order)))
        p = (n + weight * p) / (n.sum(-1, keepdims=True) + weight)
    return -np.log(p).astype(np.float32)


class Restorer:
    """Viterbi decoding of suspicious tokens; results are kept by token in a bounded memory."""

    LIMIT = 300_000
    _SIGNS, _PARTS = (re.escape("".join(x)) for x in ([c for c in LOOKALIKES if not c.isalnum()], SEPARATORS))
    SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGNS}])(?:[\s{_PARTS}]+(?:[^\W_]|[{_SIGNS}])){{2,}}(?![^\W_])")
    PLAIN = re.compile(r"[^\W\d_]+")
    TRIPLE = re.compile(r"([^\W\d_])\1\1")
    PARTED = re.compile(rf"[^\W_][{_PARTS}]+[^\W_]")
    BEFORE = re.compile(r"[^\w@$!|+]*")

    def __init__(self, model: np.ndarray):
        self.cost = array("f", np.ascontiguousarray(model, np.float32).tobytes())
        self.seen: dict[str, str] = {}

    def token(self, t: str) -> str:
        got = self.seen.get(t)
        if got is None:
            if len(self.seen) >= self.LIMIT:
                self.seen.clear()
            got = self.seen[t] = self._token(t)
        return got

    @classmethod
    def edges(cls, t: str) -> tuple[str, str, str]:
        """Leading punctuation, core and trailing punctuation of a token; signs that may stand for letters stay in the core, but for two
        or more after its last word character. Each part takes one scan."""
        first = cls.BEFORE.match(t).end()
        word = len(t)
        while word > first and not (t[word - 1].isalnum() or t[word - 1] == "_"):
            word -= 1
        end = max(word, 1 + max(t.rfind("@", word), t.rfind("$", word)))
        for k in range(word, min(end, len(t) - 1)):
            if t[k] in "$@!|+" and t[k + 1] in "$@!|+":
                end = k
                break
        return t[:first], t[first:end], t[end:]

    def _token(self, t: str) -> str:
        before, core, after = self.edges(t)
        if not any(map(str.isalpha, core)) or core.isalpha() and not self.TRIPLE.search(core):
            return t
        if not self.TRIPLE.search(core) and not self.PARTED.search(core) and not any(c in LOOKALIKES for c in core):
            return t
        return before + self.decode(core, SEPARATORS) + after

    def spaced(self, x: str) -> str:
        """`x` with its rows of single characters restored."""
        return self.SPACED.sub(lambda m: self.decode(m[0], SEPARATORS) if any(map(str.isalpha, m[0])) else m[0], x)

    def text(self, x: str) -> str:
        return re.sub(r"\S+", lambda m: self.token(m.group(0)), self.spaced(x))

    def tokens(self, x: str) -> list[str]:
        """The restored text's tokens, without keeping white space."""
        return list(map(self.token, self.spaced(x).split()))

    def decode(self, span: str, separators: str) -> str:
        """The cheapest path through the lattice of `span`: channel costs plus the model's; a run of separators counts as one break."""
        cost, wrap = self.cost, SIZE ** 3
        paths: dict[int, tuple] = {0: (0.0, None)}  # by the last three codes: cost and (path before, last piece)
        for c, run in groupby(span, lambda c: " " if c in separators or c.isspace() else c):
            piece = "".join(run)
            n = len(piece)
            options = [(piece, 0.0, _codes(c if c == " " else piece).tolist())]
            if c == " ":
                options.append(("", DROP, []))
            elif c in LOOKALIKES:
                options += [(x * m, SUBSTITUTE, _codes(x * m).tolist()) for x in LOOKALIKES[c] for m in {1, min(n, 2)}]
            elif n >= 3:
                options += [(c * m, COLLAPSE, _codes(c * m).tolist()) for m in (1, 2)]
            nxt: dict = {}
            for state, (before, path) in paths.items():
                for o, price, codes in options:
                    s, total = state, before + price
                    for k in codes:
                        at = s * SIZE + k
                        total += cost[at]
                        s = at % wrap
                    if s not in nxt or total < nxt[s][0]:
                        nxt[s] = (total, (path, o))
            paths = nxt
        path, out = min(((t + cost[s * SIZE], p) for s, (t, p) in paths.items()), key=lambda x: x[0])[1], []
        while path:
            path, o = path
            out.append(o)
        return "".join(reversed(out))


def features(word: str) -> list[str]:
    """The word and its prefixes of three to five letters; a prefix ends in '*'."""
    return [word, *(word[:k] + "*" for k in (3, 4, 5) if len(word) > k)]


def undominated(weights: dict[str, float]) -> dict[str, float]:
    """`weights` without features that a shorter prefix, present wherever they are, outweighs: no evidence changes."""
    return {f: w for f, w in weights.items() if all(weights.get(p, 0.0) < w for p in features(f.rstrip("*"))[1:])}


@dataclass
class ToxicModel:
    cost: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=list)
    cut: float = 0.0
    slope: float = 1.0
    constant: float | None = None

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Evidence of texts under a model, one for each task."""

    LIMIT = 500_000

    def __init__(self, model: ToxicModel):
        self.model = model
        self.restorer = Restorer(model.cost)
        self.seen: dict[str, tuple] = {}

    def _words(self, token: str) -> tuple:
        """(number of words, ((word, evidence), ...)) of one raw token."""
        words = Restorer.PLAIN.findall(self.restorer.token(token).lower())
        hits = []
        for w in words:
            e = max(self.model.weights.get(f, 0.0) for f in features(w))
            if e > 0:
                hits.append((w, e))
        return len(words), tuple(hits)

    def summary(self, text: str) -> list[float]:
        n, best = 0, {}
        for t in self.restorer.spaced(text).split():
            got = self.seen.get(t)
            if got is None:
                if len(self.seen) >= self.LIMIT:
                    self.seen.clear()
                got = self.seen[t] = self._words(t)
            n += got[0]
            for w, e in got[1]:
                best[w] = e
        e = sorted(best.values(), reverse=True)
        return [e[0] if e else 0.0, sum(e[:3]) / 3, float(np.log1p(len(e))), sum(e) / (len(e) + 3), len(e) / (n + 20) ** 0.5]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        x = np.array([self.summary(t) for t in texts]).reshape(-1, 5)
        s = x @ np.array(self.model.coef[1:]) + self.model.coef[0]
        return 1 / (1 + np.exp(-np.clip(self.model.slope * (s - self.model.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps; both classes weigh the same."""
    a = np.hstack((np.ones((len(x), 1)), x))
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(h, a.T @ (w * (p - y)) + ridge * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", holdout: tuple[int, int] = (3, 1), rows: int = TRAIN_ROWS) -> ToxicModel:
    """The character model from all of `docs`; weights from at most `rows` labelled documents outside the held-out fold."""
    cost = character_model(character_counts(docs))
    parts, out = holdout
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != out))
              .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # bounded by `rows`, so the broadcast has a fixed size; copies of a text count once
    sample = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("x")).join(F.broadcast(chosen), "doc_id")
              .groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).groupBy(F.xxhash64("x").alias("k")).agg(F.first("x").alias("x"), F.max("y").alias("y")).drop("k"))
    sample = written(sample, "sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicModel(cost, constant=float(next(iter(sizes))) if sizes else 0.5)

    def rows_of(total: Counter) -> pa.RecordBatch:
        f, y = zip(*total, strict=True) if total else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32()), pa.array(total.values(), pa.int64())], ["f", "y", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, total = Restorer(cost), Counter()
        for part in slices(batches):
            for x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = set(Restorer.PLAIN.findall(" ".join(restorer.tokens(x)).lower()))
                total.update((f, y) for f in {f for w in words for f in features(w)})
            if len(total) > 300_000:  # Spark adds the parts up
                yield rows_of(total)
                total.clear()
        yield rows_of(total)

    n, m = (F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) + 0.5 for y in (1, 0))
    found = sample.select("x", "y").mapInArrow(counted, "f string, y int, n long").groupBy("f").agg(n.alias("n"), m.alias("m"))
    w = F.log(F.col("n") / (sizes[1] + 1)) - F.log(F.col("m") / (sizes[0] + 1)) - 1.64 * F.sqrt(1 / F.col("n") + 1 / F.col("m"))
    heavy = found.select("f", w.alias("w")).where("n > 0.5 and w > 1").toPandas()
    weights = undominated(dict(zip(heavy["f"], heavy["w"].astype(float), strict=True)))
    if not weights:
        return ToxicModel(cost, constant=THRESHOLD * sizes[1] / (sizes[0] + sizes[1]))
    model = ToxicModel(cost, weights)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for part in slices(batches):
            s = pa.array([scorer.summary(x) for x in part.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([s, part.column(1)], ["s", "y"])

    got = sample.select("x", "y").mapInArrow(summaries, "s array<double>, y int").toPandas()
    x, y = np.array(got["s"].tolist(), float), got["y"].to_numpy()
    coef = logistic(x, y)
    s = x @ coef[1:] + coef[0]
    model.coef, model.cut = coef.tolist(), quantile_cut(s, y)
    model.slope = float(4.0 / (np.median(np.abs(s - model.cut)) + 1e-6))
    return model


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches):
            s = scorer.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, score double, predicted int")


def restored(docs: DataFrame, cost: np.ndarray) -> DataFrame:
    """(doc_id, restored): the deobfuscated text of every row."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(cost)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.text(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "restored"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, restored string")
