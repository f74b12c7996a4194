import random

import numpy as np
from fixtures import frame, odd_rows, prose

from pactline.llm import near_dedup as nd


def near(words, r, share):
    return " ".join(f"z{r.randrange(10**6)}" if r.random() < share else w for w in words.split(" "))


def by_force(rows, size, percent):
    sets = []
    for i, x, *_ in rows:
        w = (x or "").encode().lower().split()
        k = min(size, len(w))
        sets.append((i, {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()))
    label = {i: i for i, _ in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def test_classes_equal_brute_force(llm_spark):
    r = random.Random(1)
    rows = []
    for g in range(12):
        base = prose(r, r.choice([3, 12, 60, 200]))
        for _ in range(r.choice([1, 2, 5, 25])):
            rows.append((len(rows), near(base, r, r.choice([0, 0.01, 0.03, 0.06])), "en", "s", 1))
    # a chain: neighbours are alike, the ends are not
    words = prose(r, 120).split(" ")
    for k in range(8):
        rows.append((len(rows), " ".join(words), "en", "s", 1))
        for j in range(k * 10, k * 10 + 10):
            words[j] = f"c{k}x{j}"
    rows += odd_rows()
    got = sorted(map(tuple, nd.classes(frame(llm_spark, rows), size=4).collect()))
    assert got == by_force(rows, 4, 80)


def test_one_crowded_bucket_loses_no_link(llm_spark, monkeypatch):
    """Blocks far smaller than the bucket still compare every pair of components."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    r = random.Random(3)
    base = prose(r, 90)
    rows = [(i, near(base, r, 0.035), "en", "s", 1) for i in range(90)]
    got = sorted(map(tuple, nd.classes(frame(llm_spark, rows), size=4).collect()))
    assert got == by_force(rows, 4, 80)


def test_empty_table(llm_spark):
    assert nd.classes(frame(llm_spark, [])).count() == 0


def test_sketch_fills_every_bin_and_estimates_similarity():
    r = np.random.default_rng(2)
    for n in (1, 3, 40, 5000):
        s = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        assert (nd.sketch(s) != np.iinfo(np.uint64).max).all()
    a = np.unique(r.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.concatenate((a[:1600], np.unique(r.integers(0, 2**63, 400).astype(np.uint64))))
    assert abs((nd.sketch(a) == nd.sketch(np.unique(b))).mean() - 1600 / 2400) < 0.12
