"""Rows without an id: no operator may lose them, or links, hits and spans of other rows because of them."""

import random

from fixtures import DOCS, prose
from pyspark.sql import functions as F

import corpus_pipeline
from pactline.llm import near_dedup, phrase_index, secret_scan


def docs_of(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], DOCS)


def test_links_pass_through_rows_without_an_id(llm_spark):
    w = prose(random.Random(1), 60)
    other = prose(random.Random(2), 60)
    rows = [(None, w), (1, w + " more"), (2, w), (3, "else"), (None, other), (None, other + " tail"), (None, None), (None, "")]
    got = {(r["doc_id"], r["t"]): r for r in near_dedup.classes(docs_of(llm_spark, rows), size=4, text_hash=True).collect()}
    t = {x: r["t"] for x, r in ((x, llm_spark.createDataFrame([(x,)], "x string").select(F.xxhash64("x").alias("t")).first()) for _, x in rows)}
    label = {k: (r["component_id"], r["kept"]) for k, r in got.items()}
    assert label[1, t[w + " more"]] == (1, True) and label[2, t[w]] == (1, False) and label[None, t[w]] == (1, False) and label[3, t["else"]] == (3, True)
    alone = [label[None, t[other]], label[None, t[other + " tail"]]]
    assert sorted(alone) == [(None, False), (None, True)]
    assert label[None, t[None]] == (None, True) and label[None, t[""]] == (None, True)
    kept = corpus_pipeline.near_duplicates(llm_spark, docs_of(llm_spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept if r["text"]) == sorted([(1, w + " more"), (3, "else"), (0, other if alone[0][1] else other + " tail")])


def test_spans_of_rows_without_an_id(llm_spark):
    rows = [(None, "password=abcdefghijk"), (None, "nothing"), (7, "password=abcdefghijk")]
    got = secret_scan.scan(docs_of(llm_spark, rows)).select("doc_id", "n_assign", secret_scan.joined("base").alias("b")).collect()
    assert sorted((r["doc_id"] or 0, r["n_assign"], r["b"]) for r in got) == [(0, 0, ""), (0, 1, "assign:0:20"), (7, 1, "assign:0:20")]


def test_hits_of_rows_without_an_id(llm_spark):
    item = prose(random.Random(4), 60)
    docs = docs_of(llm_spark, [(None, item), (5, item), (None, prose(random.Random(9), 40)), (None, None)])
    items = llm_spark.createDataFrame([("a", item), (None, item), ("b", None)], "item_id string, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in phrase_index.contamination(docs, items).collect())
    assert got == [(0, 0, 0, ()), (0, 40, 0, ()), (0, 60, 60, ("a",)), (5, 60, 60, ("a",))]
    near = phrase_index.proximity(llm_spark, docs, {"q": item.split()[3:6]}, 3).collect()
    assert {r["doc_id"] for r in near} == {None, 5}


def test_proximity_equals_brute_force(llm_spark):
    r = random.Random(3)
    rows = [(i if i % 5 else None, " ".join(f"w{r.randrange(9)}" for _ in range(80))) for i in range(40)]
    asked = {"p": ["w1", "w2", "w3"], "q": ["w4"], "r": ["w5", "w5", "w6"], "s": ["w1", "absent"]}
    texts = " ".join(x for _, x in rows).split()
    want = []
    for name, terms in asked.items():
        rare = min(dict.fromkeys(terms), key=lambda t: (texts.count(t), [*dict.fromkeys(x for v in asked.values() for x in v)].index(t)))
        for i, x in rows:
            w = x.split()
            want += [(name, i or 0, k) for k, t in enumerate(w) if t == rare and all(v in w[max(0, k - 4):k + 5] for v in terms)]
    got = [(g["query"], g["doc_id"] or 0, g["pos"]) for g in phrase_index.proximity(llm_spark, docs_of(llm_spark, rows), asked, 4).collect()]
    assert sorted(got) == sorted(want)
