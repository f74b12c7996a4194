import numpy as np
from pyspark.sql import functions as F

from pactline.llm import box_negatives as bn

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_force(rows, k=5):
    seen, vecs = set(), []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = tuple(int(x) for x in np.floor(256 * np.array(v, np.float32).astype(float)))
        label = (label + 1) % 10 if i % 7 == 0 else label
        if (i, label, q) not in seen:
            seen.add((i, label, q))
            vecs.append((i, label, q))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for n, (a, label, q) in enumerate(vecs):
        if a % 100:
            continue
        others = [(-dot(q, w), i, lab) for m, (i, lab, w) in enumerate(vecs) if m != n]
        for s, p, _ in sorted(o for o in others if o[2] == label)[:k]:
            found = sorted((t, i) for t, i, lab in others if lab != label and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(found)]
    return sorted(out)


def rows_of(seed, n=900, d=9):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    rows = [(i, (centres[r.integers(6)] + r.normal(size=d) * 0.4).tolist(), int(r.integers(10))) for i in range(n)]
    rows += [(1000 + 10 * i, [0.5] * d, i % 3) for i in range(80)]  # copies: ties, equal anchors
    rows += [(3000 + i, (np.round(r.normal(size=d)) / 2).tolist(), i % 10) for i in range(150)]  # many equal coordinates
    rows += [(5000, None, 1), (5001, [1.0, None] * 4, 1), (5002, [float("nan")] * d, 1), (5003, [float("inf")] * d, 1), (5004, [1.0] * d, None), (5100, [0.0] * d, 4), (None, [9.0] * d, 2),
             (5200, [1.0] * 3, 4), (0, rows[0][1], rows[0][2]), (0, [0.7] * d, 5), (100, [0.7] * d, 5), (5300, [-1.0] * d, 2)]
    return rows


def test_negatives_equal_brute_force_with_many_small_tiles(llm_spark):
    rows = rows_of(4)
    df = llm_spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("q", "key", "tile", "rid", "score", "n", "part", "slab")})
    got = bn.hard_negatives(df, F.col("vec_id") % 100 == 0, tile=40, leaf=4, directory=7, part=3)
    assert sorted(map(tuple, got.collect())) == by_force(rows)


def test_negatives_equal_brute_force_in_one_tile(llm_spark):
    rows = rows_of(9, 300)
    got = bn.hard_negatives(llm_spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == by_force(rows)


def test_intervals_hold_every_product():
    r = np.random.default_rng(1)
    x, q = r.integers(-99, 99, (64, 5)).astype(float), r.integers(-99, 99, (20, 5)).astype(float)
    lo, hi = bn._boxes(x, 8)
    least, most = bn.intervals(q, lo, hi)
    score = (q @ x.T).reshape(20, 8, 8)
    assert (score.min(2) >= least).all() and (score.max(2) <= most).all()
    order = bn.str_order(x, 4, [0, 1, 2])
    assert sorted(order.tolist()) == list(range(64))


def test_huge_components_are_exact():
    q, x = np.array([[2.0 ** 40, 3.0]]), np.array([[2.0 ** 40, 1.0], [2.0 ** 40, 2.0]])
    got = bn.search_tile(q, np.array([1]), True, np.array([-2 ** 63]), np.array([2 ** 63 - 1]), np.array([-np.inf]), 2, np.array([5, 6]), np.array([1, 1]), x)
    assert sorted(g[2] for g in got) == [2 ** 63 - 1] * 2


def test_empty_and_lonely(llm_spark):
    none = llm_spark.createDataFrame([], SCHEMA)
    assert bn.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    one = llm_spark.createDataFrame([(100, [1.0], 1), (3, [1.0], 2)], SCHEMA)
    assert bn.hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0


def test_the_visits_of_requests_are_never_broadcast(llm_spark, monkeypatch):
    plans, write = [], bn.written
    monkeypatch.setattr(bn, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    rows = rows_of(4)
    got = bn.hard_negatives(llm_spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, tile=40, leaf=4, directory=7, part=3)
    assert sorted(map(tuple, got.collect())) == by_force(rows)
    met = [line for p in plans for line in p.splitlines() if "Join Inner, (tile" in line]
    asked = [line for p in plans for line in p.splitlines() if "Join Inner, (rid" in line]
    assert len(met) >= 8 and all("rightHint=(strategy=broadcast)" in line for line in met)
    assert len(asked) >= 4 and all("rightHint=(strategy=merge)" in line for line in asked)


def test_tiles_hold_the_narrowest_numbers(llm_spark):
    for most, width in ((100.0, 2), (2.0 ** 20, 4), (2.0 ** 30, 8)):
        df = llm_spark.createDataFrame([(1, [most, -most], 1), (2, [0.5, 1.0], 2)], SCHEMA)
        rows = bn.prepared(df).selectExpr("*", "0 AS slab", "0 AS cell", "0 AS part")
        assert len(bn.packed_tiles(rows, 2).first()["x"]) == 2 * 2 * width
