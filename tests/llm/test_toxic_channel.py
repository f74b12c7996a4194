import random

import numpy as np
import pytest
from fixtures import frame

from pactline.llm import toxic_channel as tc

WORDS = ["moron", "scum", "zap", "idiot", "stupid", "trash"]


@pytest.fixture(scope="module")
def restorer():
    """Under a character model of texts that hold the words in plain form."""
    r = random.Random(4)
    words = [r.choice(WORDS) if r.random() < 0.2 else "".join(r.choice("aeou") + r.choice("lnrst") for _ in range(r.randrange(1, 4))) for _ in range(20_000)]
    c = tc._codes("   " + " ".join(words) + " ")
    counts = np.bincount(((c[:-3] * tc.SIZE + c[1:-2]) * tc.SIZE + c[2:-1]) * tc.SIZE + c[3:], minlength=tc.SIZE ** 4)
    return tc.Restorer(tc.character_model(counts.astype(float)))


@pytest.mark.parametrize("hidden, plain", [
    ("s c u m.", "scum."), ("m o r o n,", "moron,"), ("(m o r o n)", "(moron)"), ("z a p", "zap"), ("m  o  r  o  n", "moron"), ("m\to\tr\to\tn", "moron"),
    ("i d ! o t", "idiot"), ("$ t u p i d", "stupid"), ("m - o - r - o - n", "moron"), ("mo.ron", "moron"), ("tra-sh", "trash"), ("m..o..r..o..n", "moron"),
    ("i.d.!.o.t", "idiot"), ("z_a_p", "zap"), ("tr-4sh", "trash"), ("m o o o o r o n", "moron"),
    ("1 2 3 4", "1 2 3 4"), ("555-3436", "555-3436"), ("tele. Nora", "tele. Nora")])
def test_spaced_and_parted_words_are_restored(restorer, hidden, plain):
    for before, after in (("", ""), ("tele nora ", " rute sola")):
        assert restorer.text(before + hidden + after) == before + plain + after
        assert restorer.tokens(before + hidden + after) == (before + plain + after).split()


def test_a_long_row_of_letters_takes_linear_time(restorer):
    assert restorer.text("a l " * 50_000).replace(" ", "") == "al" * 50_000


def test_few_toxic_rows_are_enough_and_rare_words_count(llm_spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeou") + r.choice("lnrst") for _ in range(r.randrange(2, 5)))
    docs = [(i, " ".join([word() for _ in range(12)] + ["moron"] * (i % 10 == 0)), "en", "s", 1) for i in range(60)]
    labels = llm_spark.createDataFrame([(i, int(i % 10 == 0)) for i, *_ in docs], "doc_id long, toxic int")
    df = frame(llm_spark, docs)
    model = tc.fit(df, labels, holdout=(1, 7))
    assert model.weights and all(g.predicted == int(g.doc_id % 10 == 0) for g in tc.score_documents(df, model).collect())
    # no word points to toxic texts: nothing is called toxic
    plain = frame(llm_spark, [(i, "tele nora" + " rute" * i, "en", "s", 1) for i in range(60)])
    got = tc.score_documents(plain, tc.fit(plain, labels, holdout=(1, 7))).collect()
    assert {g.predicted for g in got} == {0} and {round(g.score, 6) for g in got} == {0.07}


def test_dropped_features_change_no_evidence():
    r = random.Random(7)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 8))) for _ in range(300)]
    weights = {f: float(r.randrange(1, 5)) for w in words for f in tc.features(w) if r.random() < 0.5}
    few = tc.undominated(weights)
    assert len(few) < len(weights)
    assert all(max(weights.get(f, 0) for f in tc.features(w)) == max(few.get(f, 0) for f in tc.features(w)) for w in words)
