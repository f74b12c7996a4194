import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from pactline.operators import firms
from pactline.plans import frames, shared

SF = "/root/testdata/sf0.001"
WORDS = "Summit Harbor Oak River Fisher Capital Wealth Partners Advisors and the of buys sells & First".split()


def advisers(spark):
    rng = random.Random(3)
    rows = [(str(i), f"{rng.choice(WORDS)} {rng.choice(WORDS)} {rng.choice(WORDS)}{i % 4 or ''} LLC", f"Summit X{i} Partners", float(i)) for i in range(1, 90)]
    return spark.createDataFrame(rows, "crd string, legal_name string, business_name string, aum_usd double")


def headlines(spark):
    rng = random.Random(5)
    words = WORDS + [f"X{i}" for i in range(1, 20)] + ["buys,", "summit", "X3's", "—", "|"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(300)] + [(900, None), (901, "")]
    return spark.createDataFrame(rows, "id int, title string")


def by_two_joins(texts, aliases):
    """The hits by a join of tokens with first tokens and one of all their n-grams with aliases."""
    heads = aliases.groupBy(F.substring_index("alias", " ", 1).alias("head")).agg(F.collect_set("n").alias("lengths"))
    words = texts.select("id", firms.spoken(F.col("title")).alias("o")).select("id", "o", F.posexplode("o").alias("start", "w")).where("w <> '|'")
    starts = words.withColumn("head", firms._norm(F.col("w"))).join(heads, "head").select("id", "o", "start", F.explode("lengths").alias("n"))
    end = F.col("start") + F.col("n")
    grams = starts.where(end <= F.size("o")).select(
        "id", "start", "n", F.when(F.col("start") > 0, F.get("o", F.col("start") - 1)).alias("before"), F.slice("o", F.col("start") + 1, F.col("n")).alias("span"),
        F.get("o", end).alias("after"), F.array_join(F.transform(F.slice("o", F.col("start") + 1, F.col("n")), firms._norm), " ").alias("alias"))
    return grams.join(aliases.drop("n"), "alias")


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("crowded,small", [(32, True), (2, True), (10 ** 6, False), (2, False)])
def test_dictionary_hits_equal_two_joins(spark, monkeypatch, crowded, small):
    monkeypatch.setattr(firms, "CROWDED", crowded)
    if not small:
        monkeypatch.setattr(firms, "small_side", lambda df: df)  # as with a dictionary too large to broadcast
    a, t = firms.dictionary(advisers(spark)), headlines(spark)
    want = by_two_joins(t, a)
    assert want.count() > 100 and rows_of(firms.dictionary_hits(t, "id", "title", a)) == rows_of(want)


def test_a_token_does_not_carry_its_whole_text_to_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(firms, "small_side", lambda df: df)
    monkeypatch.setattr(firms, "CROWDED", 1000)
    long = spark.createDataFrame([(1, "Summit X3 Partners " + "word " * 500)], "id int, title string")
    hits = firms.dictionary_hits(long, "id", "title", firms.dictionary(advisers(spark)))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "bit_get" in plan
    assert hits.count() > 0


def test_links_of_teasers_are_read_once_per_text(spark, monkeypatch):
    a = advisers(spark)
    items = spark.createDataFrame([(i, f"Harborview Wealth Partners buys Summit X{i % 9 + 1} Partners", "Summit X7 Partners and Lakeside Wealth Advisors talk") for i in range(40)] + [
        (90, None, None), (91, "Nothing here", "Summit X1 Partners")], "id int, title string, description string")
    read = []
    real = firms._links
    monkeypatch.setattr(firms, "_links", lambda t, k, c, *r, **o: read.append((c, t.count())) or real(t, k, c, *r, **o))
    got = {(r.id, r.crd, r.name, r.in_title) for r in firms.item_links(items, firms.dictionary(a), a).collect()}
    assert dict(read) == {"title": 42, "description": 2}
    for i in range(40):
        own = {x[1:] for x in got if x[0] == i}
        assert own == {(str(i % 9 + 1), f"Summit X{i % 9 + 1} Partners", True), (None, "Harborview Wealth Partners", True),
                       (None, "Lakeside Wealth Advisors", False)} | ({("7", "Summit X7 Partners", False)} if i % 9 != 6 else set())
    assert {x[1] for x in got if x[0] == 91} == {"1"} and not any(x[0] == 90 for x in got)


def test_story_crds_are_the_verified_firms_of_stories(spark):
    want = shared.story_firms(spark, SF).where("crd is not null").select("component", "crd")
    assert rows_of(shared.story_crds(spark, SF)) == rows_of(want)


def read_for_firms(spark, monkeypatch, key):
    """Rows of headlines that a query looks up in the dictionary, and its result."""
    shared.forget()
    seen = []
    real = firms.dictionary_hits
    monkeypatch.setattr(firms, "dictionary_hits", lambda t, k, c, a: (seen.append(t.count()) if c == "title" else None) or real(t, k, c, a))
    out = e.queries()[key](spark, SF).collect()
    shared.forget()
    return max(seen, default=0), out


@pytest.mark.parametrize("key", ["agg_weekly_industry_counts", "out_weekly"])
def test_results_without_firms_link_none(spark, monkeypatch, key):
    assert read_for_firms(spark, monkeypatch, key)[0] == 0


@pytest.mark.parametrize("key", ["topk_largest_deals_week", "agg_weekly_recap", "out_digest", "out_digest_input", "out_trending", "agg_trending",
                                 "out_clusters", "agg_registered_aum_fallback"])
def test_only_stories_that_can_be_shown_are_linked(spark, monkeypatch, key):
    n = frames.items(spark, SF).count()
    seen, out = read_for_firms(spark, monkeypatch, key)
    assert out is not None and seen < n / 2


@pytest.mark.parametrize("key", ["agg_dataset_counts", "agg_firm_index", "agg_feed_summary", "filter_trending_verified", "out_meta"])
def test_counts_of_verified_firms_read_no_other_names(spark, monkeypatch, key):
    shared.forget()
    monkeypatch.setattr(firms, "span_names", lambda *a: pytest.fail("spans are not part of the result"))
    assert e.queries()[key](spark, SF).count() > 0
    shared.forget()
