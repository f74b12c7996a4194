import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pactline.operators import firms, graph, quality, similarity

ADVISERS = [("1", "MERCER GLOBAL ADVISORS INC.", "Mercer Advisors", 5e10), ("2", "Captrust Financial LLC", "Captrust", 8e11),
            ("3", "Summit Wealth Partners LLC", "Summit Wealth Partners", 1e9), ("4", "Summit Wealth Group", "Summit Wealth Group", 2e9),
            ("5", "Hightower Advisors LLC", "Hightower Advisors", 1e11)]


def advisers(spark):
    return spark.createDataFrame(ADVISERS, "crd string, legal_name string, business_name string, aum_usd double")


def found(spark, titles, words=None):
    d = firms.dictionary(advisers(spark), words=words)
    t = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    rows = firms.match(t, "id", "title", d).orderBy("id", "start_token").collect()
    return [[r.crd for r in rows if r.id == i] for i in range(len(titles))]


def test_matches_and_guards(spark):
    words = spark.createDataFrame([("summit",), ("mercer",)], "word string")
    got = found(spark, ["Captrust buys Mercer Advisors unit", "John Captrust speaks", "captrust is lower case",
                        "Hightower Signature hires", "Markets; Hightower Advisors, Captrust"], words)
    assert got == [["2", "1"], [], [], ["5"], ["5", "2"]]


def test_pretty_name(spark):
    df = spark.createDataFrame([("MERCER GLOBAL ADVISORS INC.",), ("LPL FINANCIAL LLC",), ("The Vanguard Group, Inc.",)], "n string")
    assert [r[0] for r in df.select(firms.pretty_name(F.col("n"))).collect()] == ["Mercer Global Advisors", "LPL Financial", "Vanguard Group"]


def test_span_names(spark):
    df = spark.createDataFrame([(1, "Harborview Wealth Partners buys $1.2bn Summit Ridge Advisors of Ohio")], "id int, t string")
    assert sorted(r.name for r in firms.span_names(df, "id", "t").collect()) == ["Harborview Wealth Partners", "Summit Ridge Advisors"]


def test_watch_terms_skip_short_ones(spark):
    w = spark.createDataFrame([("Goldman", ["GS", "Goldman Sachs"])], "name string, aliases array<string>")
    assert sorted(r.term for r in firms.watch_terms(w).collect()) == ["Goldman", "Goldman Sachs"]


def _lcs_distance(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return len(a) + len(b) - 2 * row[-1]


def test_indel_matches_brute_force(spark):
    rng = random.Random(7)
    pairs = [("".join(rng.choices("abcd ", k=rng.randint(0, 20))), "".join(rng.choices("abcd ", k=rng.randint(0, 20)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(similarity.indel("a", "b")).collect()] == [_lcs_distance(a, b) for a, b in pairs]


def _items(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source string, published_at timestamp, title string, firms array<string>")


def test_story_edges_equal_brute_force(spark):
    """Components from blocked, folded edges equal those of scoring every pair."""
    rng = random.Random(3)
    base = datetime(2026, 9, 20)
    heads = ["Acme Capital to acquire Beta Wealth for $5M", "Acme Capital buys Beta Wealth", "Gamma Bank completes merger with Delta Trust",
             "Gamma Bank and Delta Trust complete merger", "Omega sells unit to Sigma", "Totally different story about weather", "Layoffs", "The And Of"]
    rows = [(i, f"s{rng.randint(1, 3)}", base + timedelta(hours=rng.randint(0, 240)), rng.choice(heads), []) for i in range(60)]
    items = _items(spark, rows)
    got = {r.id: r.component for r in graph.with_components(items, similarity.story_edges(items)).collect()}
    sig = similarity.signatures(items).select("id", "source", "published_at", "toks", "firms", "money")
    a = sig.toDF("ia", "sa_", "pa", "ta", "fa", "ma")
    b = sig.toDF("ib", "sb_", "pb", "tb", "fb", "mb")
    every = similarity.scored(a.join(b, F.col("ia") < F.col("ib"))).where(
        "score >= 70 and sa_ <> sb_ and abs(unix_timestamp(pa) - unix_timestamp(pb)) <= 72 * 3600").select("ia", "ib").collect()
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in every:
        rx, ry = root(x), root(y)
        parent[max(rx, ry)] = min(rx, ry)
    assert got == {i: root(i) for i in parent}


def test_windows_of_stories(spark):
    t = "Harborview buys Summit Ridge Advisors"
    at = datetime(2026, 9, 1)
    rows = [(1, "a", at, t, []), (2, "b", at + timedelta(hours=48), t, []), (3, "c", at + timedelta(hours=48 + 96), t, []), (4, "c", at + timedelta(hours=145), t, [])]
    got = {r.id: r.component for r in graph.with_components(_items(spark, rows), similarity.story_edges(_items(spark, rows))).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_on_a_long_chain(spark):
    e = spark.range(1, 300).selectExpr("id as src", "id - 1 as dst")
    assert {r.component for r in graph.components(e).collect()} == {0}


def test_private_overlap_short_and_long_words(spark):
    long_word = "x" * 45
    pub = spark.createDataFrame([(1, "prefix the quick brown fox jumps over the lazy dog again and again suffix"), (2, f"aa{long_word}bb")], "k int, t string")
    priv = spark.createDataFrame([(10, "quick brown fox jumps over the lazy dog again"), (11, long_word), (12, "too short")], "private_id int, p string")
    got = {tuple(r) for r in quality.private_overlap(pub, "k", "t", priv, "p").collect()}
    assert got == {(1, 10), (2, 11)}


def test_watch_terms_of_many_lengths(spark):
    from pactline.operators import firms

    words = [f"w{i}" for i in range(130)]
    terms = spark.createDataFrame([(f"n{k}", " ".join(words[:k])) for k in range(1, 131)], "name string, term string")
    texts = spark.createDataFrame([(1, "x " + " ".join(words)), (2, " ".join(words[1:]))], "id int, text string")
    assert {(r.id, r.name) for r in firms.watch_hits(texts, "id", "text", terms).collect()} == {(1, f"n{k}") for k in range(1, 131)}
