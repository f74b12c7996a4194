"""Cases of the third review: each failed before its finding was settled."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as e
from pactline.operators import deals, firms, forms, geo, industry, similarity, wealth
from pactline.plans import q_text, shared

SF = "/root/testdata/sf0.001"


def compare(spark, key, sf=SF):
    """Rows of a query and of its SQL, as text."""
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(e.oracle_sql()[key])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = sorted(map(str, (tuple(r[n] for n in names) for r in e.queries()[key](spark, sf).collect())))
    shared.forget()
    return got, want


def test_party_names_of_phrases(spark):
    got, want = compare(spark, "deal_party_names")
    assert got == want and len(got) > 0
    df = spark.createDataFrame([("the firm said nothing",)], "t string")
    assert deals.party_names(df, {"n": F.col("t")}).first().n == ""


def test_alias_of_equal_registrants_goes_to_the_lowest_number(spark):
    rows = [(crd, "Qvrtzk Advisors", "Qvrtzk Advisors", aum) for crd, aum in (("102", 5e6), ("18", 5e6), ("9", 1e6))]
    adv = spark.createDataFrame(rows, "crd string, business_name string, legal_name string, aum_usd double")
    assert firms.alias_owners(adv).where("alias = 'qvrtzk'").first().crd == "18"


def test_nearest_keeps_a_distance_equal_to_the_reach(spark):
    # part 6892 and supplier 4 of sf0.1: the root of the sum of squares is exactly 6, hypot is one bit more
    px, py, x, y = (6892 * 17 % 9750) / 10, (6892 * 31 % 6100) / 10, 4 * 53 / 10, 4 * 29 / 10
    p = spark.createDataFrame([(6892, px, py)], "k long, px double, py double")
    f = spark.createDataFrame([(4, x, y)], "crd long, x double, y double")
    assert [r.crd for r in geo.nearest(p, f, "k").collect()] == [4]


HEADLINES = ["Acmecorp to acquire wealth management firm Betaland for $5M", "Gammaray to acquire wealth management firm Deltaone for $5M",
             "Acmecorp buys Acmecorp", "ACMECORP and Acmecorp to merge", "Zuzubb buys Epsilon", "", None, "Why Acmecorp deals keep getting bigger",
             "Thetaworks, Iotaville’s parent, sells Kappa-backed Lambdale to Muondorf", "Booking acquires Nuance", "Dealmaker buys Firmwide"]


def test_parse_by_form_equals_the_parse_of_each_headline(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HEADLINES)], "i int, title string")
    direct = deals._parsed(df, "title", True).select("i", "deal")
    assert sorted(map(str, deals.parse_deals(df, keep_rejects=True).select("i", "deal").collect())) == sorted(map(str, direct.collect()))


def test_headlines_of_one_form_are_read_once(spark):
    df = spark.createDataFrame([(t,) for t in HEADLINES[:2]], "title string")
    assert forms.with_form(df, "title", deals.KNOWN).select("_form").distinct().count() == 1


def test_made_up_words_of_different_keys_differ(spark):
    k = F.col("id")
    words = spark.range(20_000).select(F.explode(F.array(*[q_text._word(k, i) for i in range(9)])).alias("w"))
    assert words.distinct().count() == 180_000 and words.where("length(w) <> 6 or w rlike '[s0-9]'").count() == 0
    assert spark.range(200_000).select(q_text._brand(k).alias("b")).where("length(b) = 10").distinct().count() == 200_000


TAGGED = [
    ("Qvrtzk to acquire wealth management firm Bnmplk for $3M", "x"), ("Qvrtzk Bank buys Bnmplk Software", "A Food Bank notice"),
    ("Qvrtzk completes acquisition of Bnmplk", "The Automotive deal of Qvrtzk was reported"), ("Food Bank Qvrtzk acquires Bnmplk", None),
    ("Insurers&Co buys Bnmplk", "Broker-Dealer Zuzbb Payments"), ("Take-Private of Bnmplk by Qvrtzk Solar agreed", ""),
    ("Zorptal Energy in talks to buy Qvrtzk", "Energy"), ("Energyx to acquire Healthcarez for $5M", "Real  Estate"), (None, "Retail")]


def test_tags_by_form_equal_the_tags_of_each_text(spark):
    df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(TAGGED)], "i int, title string, description string")
    direct = df.select("i", industry.hits(F.coalesce("title", F.lit(""))).alias("_head"), industry.hits(F.coalesce("description", F.lit(""))).alias("_body"))
    want = {r.i: r.industries for r in industry.decided(direct).collect()}
    tagged = industry.tag(df)
    assert {r.i: r.industries for r in tagged.collect()} == want
    both = {r.i: (r.industries, r.deal) for r in deals.tagged_deals(df).collect()}
    parsed = {r.i: r.deal for r in deals.parse_deals(df).collect()}
    assert both == {i: (want[i], parsed[i]) for i in parsed} and len(both) >= 4
    # the rules are put to the distinct forms, not to every row
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "insurer|insurers" in plan(direct) and "insurer|insurers" not in plan(tagged)


def test_raw_patterns_are_read_from_the_texts_themselves(spark):
    rules = [("Metals", ("re:\\bcoppr?i[a-z]+\\b",), ())]
    df = spark.createDataFrame([("Qvrtzk buys Coppritas", ""), ("Qvrtzk buys Bnmplkas", "")], "title string, description string")
    assert [r.category for r in industry.tag(df, rules=rules).orderBy(F.desc("title")).collect()] == ["Metals", "Other"]


SPOKEN = [
    "Qvrtzk Wealth Advisors buys $1B RIA Bnmplk Family Office, as Private Wealth grows", "Exclusive: Zorptal-backed Qvrtzk Capital acquires Bnmplk",
    "Summit Ridge Advisors and Summit Ridge Advisors' rival Harborview Wealth Partners merge", "Zuzbb Capital Group of Qvrtzk Partners LLC",
    "QVRTZK Wealth & Co joins Qvrtzk Wealth", "no firm here", "", None]


def test_spans_by_form_equal_the_spans_of_each_text(spark):
    df = spark.createDataFrame(list(enumerate(SPOKEN)), "i int, t string")
    direct = df.select("i", F.posexplode(F.array_distinct(firms.firm_spans(F.col("t")))).alias("pos", "name"))
    want = sorted((r.i, r.pos, r.name) for r in direct.collect() if r.name.lower() not in firms.STOP_PHRASES)
    found = firms.span_names(df, "i", "t")
    assert sorted((r.i, r.pos, r.name) for r in found.collect()) == want and len(want) >= 6
    # the steps of a span are taken once per distinct form
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "spans" in plan(direct) and "AS cur" not in plan(found)


WEALTHY = [
    "Qvrtzk Partners acquires $2.5B RIA Bnmplk Wealth", "Qvrtzk buys Bnmplk, forming $4 billion firm", "Qvrtzk takes minority stake in Bnmplk with $900M",
    "Overvalued at $5B, Qvrtzk and Bnmplk to merge", "Qvrtzk, Zorptal and Xylophon acquire Bnmplk Advisors of Texas", "Deal: Qvrtzk adds Texas team managing $1B",
    "Qvrtzk acquires Qvrtzk's Bnmplk for $3B and $4B", "nothing", None]


def test_adviser_deals_by_form_equal_the_parse_of_each_headline(spark):
    df = spark.createDataFrame(list(enumerate(WEALTHY)), "i int, title string")
    direct = wealth._parsed(df, "title")
    found = wealth.parse_wealth(df)
    rows = lambda d: sorted(map(str, d.select("i", "wealth").collect()))
    assert rows(found) == rows(direct) and found.where("wealth is not null").count() >= 5
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "no name" in plan(direct) and "no name" not in plan(found)


def test_rare_tokens_pair_row_numbers_and_no_reachable_pair_is_lost(spark):
    """Pairs that reach the threshold are those of all candidates, fewer candidates are left, and the join on rare tokens carries no headline."""
    import random

    rng = random.Random(5)
    name = lambda: "".join(rng.choices("bcdfghjklm", k=rng.randint(4, 9)))
    kept = [name() for _ in range(60)]
    titles = []
    for i in range(420):
        a, b = (rng.choice(kept), rng.choice(kept)) if i % 3 else (name(), name())
        titles.append(rng.choice([f"{a} completes acquisition of {b}", f"{a} takes minority stake in {b}", f"{b} agrees to be acquired by {a}",
                                  f"{a} {a} buys wealth unit {b} for ${rng.randint(1, 3)}M", f"{a} {b} {name()} merge"]))
    rows = [(i, "o", f"2026-09-{1 + i % 4:02d} 0{i % 10}:00:00", t, rng.choice([[], ["1", "2"], ["3"], ["4", "5"]])) for i, t in enumerate(titles)]
    sigs = similarity.signatures(spark.createDataFrame(rows, "id long, source string, published_at string, title string, firms array<string>")).cache()
    key = lambda d: {tuple(r) for r in d.select("sig_a", "slot_a", "sig_b", "slot_b").collect()}
    every, some = similarity.candidate_pairs(sigs), similarity.candidate_pairs(sigs, at_least=70.0)
    near = key(some)
    times = {(r.sig, r.slot): (r.lo, r.hi) for r in sigs.groupBy("sig", "slot").agg(
        F.min(F.unix_timestamp(F.col("published_at").cast("timestamp"))).alias("lo"), F.max(F.unix_timestamp(F.col("published_at").cast("timestamp"))).alias("hi")).collect()}
    in_time = lambda p: max(times[p[2:]][0] - times[p[:2]][1], times[p[:2]][0] - times[p[2:]][1]) <= 72 * 3600
    assert key(similarity.scored(some, 70.0)) == {p for p in key(similarity.scored(every, 70.0)) if in_time(p)} != set()
    assert len(near) < len(key(every))
    assert key(similarity.scored(every).where("score >= 70")) == key(similarity.scored(every, 70.0))
    sigs.unpersist()


def test_story_joins_equal_their_sql(spark):
    for key in ("join_fuzzy_window_self", "cluster_stories"):
        got, want = compare(spark, key)
        assert got == want and len(got) > 0


def test_queries_that_read_items_once_store_none(spark):
    """Items kept whole in storage made every column of every row, and more frames than a query uses."""
    for key in ("src_rules", "norm_headline", "filter_exclude_sources", "topk_digest", "sort_deals_multi", "sink_public_docs", "agg_cluster_rollup"):
        shared.forget()
        e.queries()[key](spark, SF)
        assert shared._KEPT == {}, key


def test_filtered_feed_links_no_firms_and_stores_no_snapshot(spark):
    got, want = compare(spark, "filter_feed_query")
    assert got == want
    for key, kept in (("filter_feed_query", {"items"}), ("out_clusters", {"items", "matches", "dictionary", "full_items"})):
        e.queries()[key](spark, SF)
        assert {k[2] for k in shared._KEPT} == kept
        shared.forget()


def test_known_words_take_their_meaning(spark):
    df = spark.createDataFrame([("Qvrtzk snaps up three funds, jobs cuts at Bnmplks and etfs glass",)], "t string")
    plan = similarity.headline_tokens(F.col("t"))
    assert df.select(plan.alias("k")).first().k == ["qvrtzk", "acquire", "3", "fund", "staff", "cut", "bnmplk", "etf", "glass"]
