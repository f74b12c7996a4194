import random
import zlib

import numpy as np
import pytest
from fixtures import frame, odd_rows, prose

from pactline.llm import quality_ranking as qr
from pactline.llm import toxic_channel as tc


def corpus(r, n):
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        words = ["".join(r.choice("aeiou") + r.choice("lnrst") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 80))]
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grunk", "blorf", "snivel"]))
        text = " ".join(words) + "."
        docs.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data():
    return corpus(random.Random(8), 600)


def held_out_accuracy(got, labels, at, parts, out):
    truth = {x[0]: x[at] for x in labels}
    rows = [g for g in got if g.doc_id in truth and zlib.crc32(str(g.doc_id).encode()) % parts == out]
    return np.mean([g.predicted == truth[g.doc_id] for g in rows])


def test_quality(llm_spark, data):
    docs, labels = data
    lab = llm_spark.createDataFrame([*labels, (0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = frame(llm_spark, docs + odd_rows())
    got = qr.score_documents(df, qr.fit(df, lab)).collect()
    assert len(got) == len(docs) + len(odd_rows()) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got)
    assert held_out_accuracy(got, labels, 1, 4, 2) > 0.95
    one = qr.fit(df, lab.where("quality = 1"))
    assert {g.score for g in qr.score_documents(df, one).collect()} == {1.0}
    assert {g.score for g in qr.score_documents(df, qr.fit(df, lab.where("false"))).collect()} == {0.5}
    assert qr.score_documents(frame(llm_spark, []), qr.fit(df, lab)).count() == 0


def test_pairwise_weights_reach_the_stationary_point():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + r.logistic(size=300) > 0).astype(int)
    m = qr.fit_pairs(x, y, pairs=20_000)
    assert np.corrcoef(m.weights, [1, -2, 0.5])[0, 1] > 0.97
    s = m.strengths(x)
    keep = s >= m.cut
    best = max((y[s >= c].sum() / y.sum() + (1 - y)[s < c].sum() / (1 - y).sum() for c in np.quantile(s, np.linspace(0, 1, 301))))
    assert y[keep].sum() / y.sum() + (1 - y)[~keep].sum() / (1 - y).sum() >= best - 0.03


def test_toxic(llm_spark, data):
    docs, labels = data
    lab = llm_spark.createDataFrame([*labels, (0, None, None)], "doc_id long, quality int, toxic int")
    df = frame(llm_spark, docs + odd_rows())
    model = tc.fit(df, lab)
    got = tc.score_documents(df, model).collect()
    assert len(got) == len(docs) + len(odd_rows()) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got)
    assert held_out_accuracy(got, labels, 2, 3, 1) > 0.95
    restorer = tc.Restorer(model.cost)
    hidden = {"gr|_|nk": None, "bl0rf": "blorf", "$nivel": "snivel", "s n i v e l": "snivel", "b-l-o-r-f": "blorf", "bloooorf": "blorf", "ata 12 le.": "ata 12 le."}
    for x, want in hidden.items():
        if want:
            assert restorer.text(x) == want
    plain, masked = model.scorer().scores(["tele nora blorf snivel", "tele nora bl0rf s n i v e l"])
    assert plain == masked >= 0.7
    assert {g.score for g in tc.score_documents(df, tc.fit(df, lab.where("toxic = 0"))).collect()} == {0.0}
    texts = {g.doc_id: g.restored for g in tc.restored(df, model.cost).collect()}
    assert texts[900] == "" and texts[0] == docs[0][1]


def test_viterbi_is_the_cheapest_path():
    r = np.random.default_rng(3)
    model = tc.character_model(r.integers(0, 50, tc.SIZE ** 4).astype(float))
    restorer = tc.Restorer(model)

    def cost(s):
        c = [0, 0, 0, *tc._codes(s), 0]
        return sum(model[tuple(c[i:i + 4])] for i in range(len(c) - 3))

    for span in ("a1b0", "4bbb3c", "l0l1"):
        options = [("", 0.0)]
        for c in ("a1b0", ) if span == "a1b0" else (span,):
            i = 0
            while i < len(c):
                n = 1
                while i + n < len(c) and c[i + n] == c[i]:
                    n += 1
                step = [(c[i] * n, 0.0)]
                if c[i] in tc.LOOKALIKES:
                    step += [(x * m, tc.SUBSTITUTE) for x in tc.LOOKALIKES[c[i]] for m in {1, min(n, 2)}]
                elif n >= 3:
                    step += [(c[i], tc.COLLAPSE), (c[i] * 2, tc.COLLAPSE)]
                options = [(o + s, p + q) for o, p in options for s, q in step]
                i += n
        assert restorer.decode(span, "") == min(options, key=lambda o: o[1] + cost(o[0]))[0]
