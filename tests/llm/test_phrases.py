import random
import re

from fixtures import frame, odd_rows, prose

from pactline.llm import phrase_index as pi


def words(x):
    low = re.sub("[A-Z]", lambda m: m.group(0).lower(), x or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_force(rows, items, width=13):
    out = []
    for i, x, *_ in rows:
        d, hit, got = words(x), set(), set()
        for k, y in items:
            w = words(y)
            n = min(width, len(w))
            for s in range(len(w) - n + 1 if w else 0):
                for p in range(len(d) - n + 1):
                    if d[p:p + n] == w[s:s + n]:
                        hit.update(range(p, p + n))
                        got.add(str(k))
        out.append((i, len(d), len(hit), sorted(got)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(llm_spark):
    r = random.Random(4)
    items = [(k, prose(r, r.choice([2, 13, 30, 40]), 300)) for k in range(14)] + [(20, None), (21, "!!"), (22, "Rare"), (3, "a second text of one id " * 3)]
    rows = []
    for i in range(60):
        parts = [prose(r, r.randrange(1, 60), 300)]
        for _ in range(r.randrange(3)):
            y = words(r.choice(items)[1])
            a = r.randrange(len(y) + 1)
            parts.append(", ".join(y[a:a + r.choice([5, 12, 13, 20, 40])]).upper())
        r.shuffle(parts)
        rows.append((i, " | ".join(parts), "en", "s", 1))
    rows += odd_rows()
    bench = llm_spark.createDataFrame(items, "item_id long, text string")
    want = by_force(rows, items)
    for block in (pi.BLOCK_WORDS, 40):
        got = pi.contamination(frame(llm_spark, rows), bench, block_words=block)
        assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x.item_ids)) for x in got.collect()), key=str) == want


def test_empty_tables(llm_spark):
    bench = llm_spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "some words", "en", "s", 1)]
    assert [tuple(x)[2:4] for x in pi.contamination(frame(llm_spark, rows), bench).collect()] == [(2, 0)]
    bench = llm_spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert pi.contamination(frame(llm_spark, []), bench).count() == 0


def test_proximity(llm_spark):
    rows = [(1, "alpha b c d beta", "en", "s", 1), (2, "alpha b c d e f g beta", "en", "s", 1), (3, "beta alpha", "en", "s", 1), (4, "alpha", "en", "s", 1)]
    got = pi.proximity(llm_spark, frame(llm_spark, rows), {"q": ["alpha", "beta"], "r": ["b", "d", "c"]}, slop=4)
    pairs = {(x.query, x.doc_id) for x in got.collect()}
    assert pairs == {("q", 1), ("q", 3), ("r", 1), ("r", 2)}
