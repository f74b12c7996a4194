"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile.

Every labelled good document is preferred to every labelled bad one. The strength of a document is linear in its text
features; the weights maximise the Bradley-Terry likelihood, that is the logistic loss on feature differences of sampled
pairs. The cut is the quantile of the training scores that separates the labels best, and strengths are mapped to 0..1 so
that the cut lands on 0.7.

Defined cases: null text counts as empty and is scored like any text; without labels of both classes all documents get the
share of label 1 (0.5 without labels) as their score; null labels are left out; a document labelled more than once counts
as good when any label says so; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, free_name, slices

# Bound on the labelled documents whose features reach the driver, and on the preference pairs made of them.
TRAIN_ROWS = 20_000
TRAIN_PAIRS = 60_000
THRESHOLD = 0.7

_KINDS = np.full(256, 7, np.uint8)
_KINDS[ord("a"):ord("z") + 1] = 0
_KINDS[ord("A"):ord("Z") + 1] = 1
_KINDS[ord("0"):ord("9") + 1] = 2
_KINDS[[9, 10, 13, 32]] = 3
_KINDS[[ord(c) for c in ".,;:"]] = 4
_KINDS[[ord(c) for c in "!?"]] = 5
_KINDS[ord("|")] = 6
_KINDS[128:] = 8
_TABLE = _KINDS.tobytes()
NAMES = ["lower", "upper", "digit", "space", "stop", "bang", "bar", "symbol", "other", "upper_letters", "distinct_words", "repeats",
         "distinct_lines", "closed_lines", "word_length", "log_words", "log_lines"]


def text_features(text: str | None) -> list[float]:
    """Shares of byte kinds, repetition of words and lines, and lengths of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw) + 1
    counts = np.bincount(np.frombuffer(raw.translate(_TABLE), np.uint8), minlength=9)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    nw, nl = len(words) + 1, len(lines) + 1
    return [*(np.sqrt(counts / n)).tolist(), float(counts[1]) / float(counts[0] + counts[1] + 1), len(set(words)) / nw ** 0.8,
            (repeats / nw) ** 0.5, len(set(lines)) / nl, sum(x[-1:] in b".!?" for x in lines) / nl, min(n / nw, 40.0) ** 0.5,
            float(np.log(nw)), float(np.log(nl))]


@dataclass
class PairwiseModel:
    """Bradley-Terry weights on standardised features, the cut and the slope of the score."""

    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    cut: float = 0.0
    slope: float = 1.0
    constant: float | None = None

    def strengths(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -6, 6)
        return z @ np.array(self.weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strengths(x) - self.cut) + shift, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = TRAIN_PAIRS, ridge: float = 1e-2, seed: int = 7) -> PairwiseModel:
    """Newton steps on the mean logistic loss of feature differences good - bad."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return PairwiseModel(constant=float(np.mean(y)) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    # every document of the smaller class takes part equally often, partners of the larger class in shuffled rounds
    many, few = (good, bad) if len(good) >= len(bad) else (bad, good)
    n = min(pairs, len(good) * len(bad))
    a = np.resize(rng.permutation(many), n)
    b = np.resize(rng.permutation(few), n)
    rng.shuffle(b)
    d = (z[a] - z[b]) * (1 if many is good else -1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # chance that the bad one wins
        g = -(d.T @ p) / n + ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    cut = quantile_cut(s, y)
    model = PairwiseModel(mean.tolist(), scale.tolist(), w.tolist(), cut)
    spread = np.median(np.abs(s - cut)) + 1e-6
    model.slope = float(4.0 / spread)
    return model


def quantile_cut(s: np.ndarray, y: np.ndarray, steps: int = 2000) -> float:
    """The score quantile with the best balanced accuracy; among equals the middle of the widest gap of scores."""
    levels = np.unique(np.quantile(s, np.linspace(0, 1, steps + 1)))
    good, bad = np.sort(s[y == 1]), np.sort(s[y == 0])
    rate = (1 - np.searchsorted(good, levels) / len(good)) + np.searchsorted(bad, levels) / len(bad)
    best = levels[np.flatnonzero(rate >= rate.max() - 1e-12)]
    # scores at or above the cut are kept, so it may sit anywhere above the best rejected score
    below = s[s < best[0]]
    return float((best[-1] + (below.max() if len(below) else best[0])) / 2)


def with_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """(doc_id, features, extra columns) of every document."""
    extra = extra or []
    src = docs.select(doc_id, F.coalesce(text, F.lit("")).alias(text), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = pa.array([text_features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), f, *(b.column(2 + i) for i in range(len(extra)))], [doc_id, "features", *extra])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([f"`{doc_id}` {kinds[doc_id]}", "features array<double>", *(f"`{c}` {kinds[c]}" for c in extra)]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", holdout: tuple[int, int] = (4, 2), rows: int = TRAIN_ROWS) -> PairwiseModel:
    """Learn from at most `rows` labelled documents outside the held-out fold, taken in the order of a hash of the id."""
    parts, out = holdout
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != out))
              .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # bounded by `rows`, so the broadcast has a fixed size
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("_y"))
    # in the order of the ids, so that a task run again cannot change the model
    got = with_features(train, extra=["_y"]).select("doc_id", "features", "_y").toPandas().sort_values("doc_id")
    if not len(got):
        return PairwiseModel(constant=0.5)
    return fit_pairs(np.array(got["features"].tolist(), float), got["_y"].to_numpy())


def score_documents(docs: DataFrame, model: PairwiseModel, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score, predicted) per row, with the columns in `keep` carried along (clashing names are the caller's)."""
    keep = keep or []
    src = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias(free_name("_t", keep)), *keep)
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if not b.num_rows:
                continue
            x = np.array([text_features(t) for t in b.column(1).to_pylist()])
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), *(b.column(2 + i) for i in range(len(keep)))],
                ["doc_id", "score", "predicted", *keep])

    return src.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "score double", "predicted int", *(f"`{c}` {kinds[c]}" for c in keep)]))
