"""Allow and block verdicts for URLs: longest-match rules, and boosted trees on lexical features for the rest.

Rules name a host and the beginning of a path; a rule fits its host and every subdomain. URLs that a rule judges are the
labelled ones. Trees learn from them: length, host and path shape, depth, digit ratio, character entropy, parameter counts and
suffix statistics (how many labelled URLs of the same top-level domain, registered domain or path ending are blocked). The
statistics cover all labelled rows; suffixes share `BUCKETS` hashed counters of each kind, so what reaches the driver has one
size for every corpus. The trees are fitted by Newton boosting on at most `TRAIN_ROWS` labelled rows, the same number of each
verdict at most, taken by a hash of URL and id; each is shown with its suffix statistics and again without
those of its host.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and is judged by the trees like any
other; a host keeps its port and user part; of rules of equal length the one with the longer host wins; without labelled rows
everything unruled is allowed, with one verdict only the trees give that verdict; rows are judged one by one, so repeated rows
and null or repeated ids keep their rows; an empty table gives an empty result; very long URLs are read whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Verdict, host and path of the rules that the registered query applies (fixed values).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
TRAIN_ROWS = 20_000
BUCKETS = 4_096
KINDS = 3
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host up to `/`, `?`, `#` or the end, A-Z in lower case, and the path up to `?`, `#` or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [k for k in map(rest.find, "/?#") if k >= 0]
    cut = min(ends, default=len(rest))
    tail = rest[cut:]
    stops = [k for k in map(tail.find, "?#") if k >= 0]
    return rest[:cut].translate(_LOWER), tail[:min(stops, default=len(tail))]


class RuleBook:
    """Rules by host; a lookup visits the suffixes of a host that start a label."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        at = 0
        while host:
            suffix = host[at:]
            for start, verdict in self.by_host.get(suffix, ()):
                size = (len(suffix) + len(start), len(suffix))
                if path.startswith(start) and (best is None or size > best[0]):
                    best = size, suffix + start, verdict
            at = host.find(".", at) + 1
            if not at:
                break
        return best and best[1:]


NAMES = ["length", "host_length", "path_length", "labels", "depth", "digits", "host_digits", "entropy", "hyphens", "parameters", "query_length", "fragment", "secure", "odd"]


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features of NAMES."""
    counts = Counter(url)
    n = max(1, len(url))
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(counts[c] for c in "0123456789")
    return [len(url), len(host), len(path), host.count(".") + 1, path.count("/"), digits / n, sum(map(host.count, "0123456789")),
            -sum(c / n * math.log2(c / n) for c in counts.values()), counts["-"], query.count("=") + query.count("&"), len(query),
            float("#" in url), float(url[:8].translate(_LOWER) == "https://"), sum(counts[c] for c in "%~_@$!")]


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    """Top-level domain, registered domain and the ending of the path's last part."""
    labels = host.rsplit(".", 2)
    last = path.rsplit("/", 1)[-1]
    return labels[-1], ".".join(labels[-2:]), last.rpartition(".")[2] if "." in last else ""


def _buckets(host: str, path: str) -> list[int]:
    return [k * BUCKETS + xxhash.xxh64_intdigest(s, seed=k) % BUCKETS for k, s in enumerate(suffixes(host, path))]


@dataclass
class Tree:
    """Splits by level order: node k goes to 2k+1 where its feature's bin is at most the cut, else to 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (bins[np.arange(len(bins)), self.feature[at]] > self.cut[at])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class UrlModel:
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    statistics: np.ndarray | None = None
    constant: float | None = 0.0

    def features(self, lexical_rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Lexical features beside each suffix's blocked share and support."""
        n, blocked = self.statistics[buckets, 0], self.statistics[buckets, 1]
        prior = 1 / (1 + math.exp(-self.base))
        return np.hstack((lexical_rows, (blocked + 20 * prior) / (n + 20), np.log1p(n)))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def scores(self, lexical_rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The chance of `block`."""
        if self.constant is not None:
            return np.full(len(lexical_rows), self.constant)
        bins = self.binned(self.features(lexical_rows, buckets))
        s = self.base + sum(t.predict(bins) for t in self.trees)
        return 1 / (1 + np.exp(-s))


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> Tree:
    """One tree on gradients and curvatures; a split is the first of those with the highest gain."""
    nodes = 2 ** (DEPTH + 1) - 1
    feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, BINS), np.zeros(nodes)
    at = np.zeros(len(bins), np.int64)
    for level in range(DEPTH):
        first, width = 2 ** level - 1, 2 ** level
        best = np.zeros(width)
        for f in range(bins.shape[1]):
            key = (at - first) * (BINS + 1) + bins[:, f]
            gs, hs = (np.cumsum(np.bincount(key, w, width * (BINS + 1)).reshape(width, -1), 1) for w in (g, h))
            total_g, total_h = gs[:, -1:], hs[:, -1:]
            gain = gs ** 2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g ** 2 / (total_h + ridge)
            gain[(hs < 1) | (total_h - hs < 1)] = 0
            k = gain.argmax(1)
            top = gain[np.arange(width), k]
            better = top > best + 1e-9
            best[better], feature[first:first + width][better], cut[first:first + width][better] = top[better], f, k[better]
        at = 2 * at + 1 + (bins[np.arange(len(bins)), feature[at]] > cut[at])
    gs, hs = (np.bincount(at, w, nodes) for w in (g, h))
    value[:] = -RATE * gs / (hs + ridge)
    return Tree(feature, cut, value)


def boost(model: UrlModel, lexical_rows: np.ndarray, buckets: np.ndarray, y: np.ndarray) -> UrlModel:
    # each row again with its registered domain unknown, and with its top-level domain unknown too: rules follow suffixes, and
    # the trees must also judge hosts that no rule knows
    unknown = len(model.statistics) - 1
    shown = [buckets.copy() for _ in range(KINDS)]
    shown[1][:, 1] = unknown
    shown[2][:, :2] = unknown
    x = np.vstack([model.features(lexical_rows, k) for k in shown])
    y = np.tile(y, len(shown))
    model.edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS, method="lower")) for k in range(x.shape[1])]
    bins = model.binned(x)
    s = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-s))
        tree = grow(bins, p - y, p * (1 - p))
        model.trees.append(tree)
        s += tree.predict(bins)
    return model


def _rows(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, url, host, path, rule, ruled, x, buckets) of every page."""
    src = pages.select("page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = RuleBook(rules)
        for b in slices(batches, 4096):
            host, path, rule, ruled, x, buckets = [], [], [], [], [], []
            for url in b.column(1).to_pylist():
                h, p = host_and_path(url)
                found = book.find(h, p) or (None, None)
                host.append(h)
                path.append(p)
                rule.append(found[0])
                ruled.append(found[1])
                x.append(lexical(url or "", h, p))
                buckets.append(_buckets(h, p))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1).cast(pa.string()), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array(ruled, pa.string()),
                 pa.array(x, pa.list_(pa.float64())), pa.array(buckets, pa.list_(pa.int32()))], ["page_id", "url", "host", "path", "rule", "ruled", "x", "buckets"])

    return src.mapInArrow(run, f"page_id {dict(src.dtypes)['page_id']}, url string, host string, path string, rule string, ruled string, x array<double>, buckets array<int>")


def fit(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, train_rows: int = TRAIN_ROWS) -> UrlModel:
    """Trees and suffix statistics learnt from the pages that a rule judges."""
    labelled = _rows(pages, RULES if rules is None else rules).where("rule is not null").withColumn("y", F.when(F.col("ruled") == "block", 1).otherwise(0))
    # KINDS * BUCKETS rows at most
    got = labelled.select("y", F.explode("buckets").alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("blocked")).toPandas()
    statistics = np.zeros((KINDS * BUCKETS + 1, 2))  # the last stands for an unknown suffix
    statistics[got["k"].to_numpy(int)] = got[["n", "blocked"]].to_numpy(float)
    n, blocked = statistics[:BUCKETS].sum(0)  # each row counts once in each kind
    if not n or blocked in (0, n):
        return UrlModel(constant=float(bool(n) and blocked == n))
    order = [F.xxhash64("url", "page_id"), F.col("url"), F.col("page_id")]
    sample = []
    for y in (0, 1):
        rows = labelled.where(F.col("y") == y).select("x", "buckets", "y", "url", "page_id").orderBy(*order).limit(train_rows // 2)
        sample.append(rows.select("x", "buckets", "y").toPandas())
    x, buckets, y = (np.array([v for s in sample for v in s[c]]) for c in ("x", "buckets", "y"))
    model = UrlModel(base=math.log(blocked / (n - blocked)), statistics=statistics, constant=None)
    return boost(model, x, buckets, y)


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] | None = None, cut: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): the rule's verdict, else `block` where the trees give at least `cut`."""
    rows = _rows(pages, RULES if rules is None else rules).select("page_id", "host", "path", "rule", "ruled", "x", "buckets")
    sent = rows.sparkSession.sparkContext.broadcast(model)  # the trees and KINDS * BUCKETS counters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            width = len(NAMES)
            x = b.column(5).flatten().to_numpy().reshape(-1, width)
            score = own.scores(x, b.column(6).flatten().to_numpy().reshape(-1, KINDS))
            ruled = b.column(4).to_pylist()
            verdict = [r or ("block" if s >= cut else "allow") for r, s in zip(ruled, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(verdict, pa.string()), pa.array(score)],
                                             ["page_id", "host", "path", "rule", "verdict", "block_score"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string, block_score double")
