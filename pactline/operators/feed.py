"""Interactive queries over story and deal frames: filters, sorts, facets, pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..rules import REGIONS
from . import search_index

_WORD = r"[\p{L}\p{N}_$&.'-]+"


@dataclass(frozen=True)
class FeedQuery:
    q: str = ""
    industries: tuple[str, ...] = ()
    outlet: str = ""
    region: str = ""
    day_from: str = ""
    day_to: str = ""
    watched_only: bool = False


def region_states(region: str) -> tuple[str, ...]:
    return REGIONS.get(region, (region,))


def matches_industry(industries: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(industries, F.array(*[F.lit(i) for i in wanted])) if wanted else F.lit(True)


def search_words(c: DataFrame) -> Column:
    """Lower-case words of headline, firms, outlets, industries and parties of a story."""
    text = F.concat_ws(" ", "headline", F.transform("firms", lambda f: f["name"]), F.transform("sources", lambda s: s["name"]),
                       "industries", "deal.acquirer", "deal.target")
    return words_in(text)


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)


def query_terms(q: str) -> list[str]:
    """Lower-case terms of a search text without punctuation at their ends."""
    terms = [t.strip(".'-") for t in re.findall(r"[\w$&.'-]+", q.lower())]
    return [t for t in terms if t]


def filter_feed(clusters: DataFrame, query: FeedQuery, watched: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """Stories that pass every set filter; every term must start some word.

    With `index`, a folder written by `search_index.write_index` over the same stories, the terms are looked up there and
    no text is scanned.
    """
    out = clusters.where(matches_industry(F.col("industries"), query.industries))
    if query.outlet:
        out = out.where(F.exists("sources", lambda s: s["name"] == query.outlet))
    if query.region:
        out = out.where(F.arrays_overlap("states", F.array(*[F.lit(s) for s in region_states(query.region)])))
    if query.day_from:
        out = out.where(dates.local_day(F.col("last_published")) >= F.lit(query.day_from).cast("date"))
    if query.day_to:
        out = out.where(dates.local_day(F.col("first_published")) <= F.lit(query.day_to).cast("date"))
    terms = query_terms(query.q)
    if terms and index:
        out = out.join(search_index.find(clusters.sparkSession, index, terms), "id", "left_semi")
    elif terms:
        out = out.withColumn("_words", search_words(out))
        starts = lambda t: F.exists("_words", lambda w: F.startswith(w, F.lit(t)))
        for t in terms:
            out = out.where(starts(t))
        out = out.drop("_words")
    if query.watched_only:
        out = out.join(watched.select("id"), "id", "left_semi")
    return out


def feed_summary(clusters: DataFrame) -> DataFrame:
    """Stories, outlets and states of a filtered feed in one pass per nested list."""
    s = clusters.agg(F.count(F.lit(1)).alias("stories"))
    o = clusters.select(F.explode("sources.name").alias("v")).agg(F.countDistinct("v").alias("outlets"))
    st = clusters.select(F.explode("states").alias("v")).agg(F.countDistinct("v").alias("states"))
    one = lambda df: df.withColumn("_j", F.lit(1))
    return one(s).join(one(o), "_j").join(one(st), "_j").drop("_j")


def whole_feed_summary(items: DataFrame, firms: DataFrame, states: DataFrame, by: str = "component") -> DataFrame:
    """`feed_summary` of the feed of all stories, from its items, the verified firms of stories (crd) and their states (crd, state)."""
    one = lambda df, name: df.distinct().agg(F.count(F.lit(1)).alias(name)).withColumn("_j", F.lit(1))
    named = states.where(F.col("state").isNotNull()).join(firms.select("crd"), "crd", "left_semi").select("state")
    return one(items.select(by), "stories").join(one(items.select("source"), "outlets"), "_j").join(one(named, "states"), "_j").drop("_j")


def newest_first(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("last_published"), F.desc("id"))


def page(clusters: DataFrame, number: int, size: int = 50) -> DataFrame:
    """Rows of one page of a feed, newest first."""
    return newest_first(clusters).offset((number - 1) * size).limit(size)


def day_heads(clusters: DataFrame) -> DataFrame:
    """Feed rows with the local day and whether a new day starts. Days are independent, so each is ordered alone:
    the first row of a local day in feed order is the one that opens it."""
    day = dates.local_day(F.col("last_published"))
    top = clusters.groupBy(day.alias("day")).agg(F.max(F.struct("last_published", "id")).alias("top"))
    return clusters.withColumn("day", day).join(top, "day").select(
        "id", "day", (F.struct("last_published", "id") == F.col("top")).alias("opens_day"))


def highlight(text: Column, q: str) -> Column:
    terms = [re.sub(r"[^\w$.&'-]", "", t) for t in q.split()]
    terms = [re.escape(t) for t in terms if len(t) > 1]
    return F.regexp_replace(text, "(?i)(" + "|".join(terms) + ")", "<mark>$1</mark>") if terms else text


def rank_order() -> list[Column]:
    return [F.desc("outlet_count"), F.desc("last_published"), F.desc("id")]


def window_start(previous: Column, now: Column) -> Column:
    """Start of the top-stories window: the previous run, but at least a day back."""
    floor = now - F.make_dt_interval(F.lit(1))
    return F.coalesce(F.least(previous, floor), floor)


def window_candidates(clusters: DataFrame, start: Column) -> DataFrame:
    return clusters.where((F.col("first_seen") > start) & (F.col("last_published") >= start - F.make_dt_interval(F.lit(2))))


def top_stories(clusters: DataFrame, start: Column, n: int = 15) -> DataFrame:
    """Ranked stories of the window; the limit comes first, so ranks are assigned to n rows only."""
    top = window_candidates(clusters, start).orderBy(*rank_order()).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def watch_first(ranked: DataFrame, watched: DataFrame) -> DataFrame:
    """Watched rows first, each part in rank order, renumbered (input is a bounded digest)."""
    j = ranked.join(watched.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False)))
    return j.withColumn("n", F.row_number().over(Window.orderBy(F.desc("hit"), "rank")))


# fixed values: display words that the deal table sorts by
TYPE_WORDS = {"acquisition": "Acquisition", "merger": "Merger", "stake": "Minority", "recapitalization": "Recap"}
STAGE_WORDS = {"announced": "Announced", "completed": "Completed", "rumored": "Rumored", "bid": "Bid", "terminated": "Called off"}


def _shown(col: Column, words: dict[str, str]) -> Column:
    out = F.lit("~")
    for k, v in words.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def sort_key(name: str) -> Column:
    """Sort value of the deal table: missing names sort as '~', missing numbers as -1."""
    keys = {
        "date": F.col("deal_date"), "acq": F.lower(F.coalesce("acquirer", F.lit("~"))),
        "tgt": F.lower(F.coalesce("target", F.lit("~"))), "ind": F.get("industries", F.lit(0)),
        "type": _shown(F.col("deal_type"), TYPE_WORDS), "stage": _shown(F.col("stage"), STAGE_WORDS),
        "p": F.coalesce("value_usd", F.lit(-1.0)), "a": F.coalesce("target_aum_usd", F.lit(-1.0))}
    return keys[name]


def sort_deals(deals: DataFrame, key: str = "date", ascending: bool = False) -> DataFrame:
    k = sort_key(key)
    return deals.orderBy(k.asc() if ascending else k.desc(), F.desc("deal_date"), F.desc("cluster_id"))


def filter_deals(deals: DataFrame, confidence: str = "", industries: tuple[str, ...] = ()) -> DataFrame:
    out = deals.where(matches_industry(F.col("industries"), industries))
    return out.where(F.col("confidence") == confidence) if confidence else out


def trailing_deals(deals: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Deals of the trailing local days."""
    return deals.where(dates.local_day(F.col("deal_date")) >= F.date_sub(dates.local_day(now), days))


def largest_deals(deals: DataFrame, now: Column, days: int = 7, n: int = 6) -> DataFrame:
    """Trailing local days with a price or a headline AUM, largest price first."""
    stated = F.col("value_usd").isNotNull() | (F.col("target_aum_source") == "headline")
    recent = trailing_deals(deals, now, days).where(stated)
    return recent.orderBy(F.coalesce("value_usd", F.lit(0.0)).desc(), F.desc("deal_date"), F.desc("cluster_id")).limit(n)


def industry_facets(clusters: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Stories per industry: all time and over the trailing local days."""
    recent = dates.local_day(F.col("last_published")) >= F.date_sub(dates.local_day(now), days)
    return clusters.select(F.explode("industries").alias("industry"), recent.alias("recent")).groupBy("industry").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("recent").alias("n_recent"))


def archive_weeks(days: DataFrame, day: str) -> DataFrame:
    return days.groupBy(dates.monday_of(F.col(day)).alias("monday")).agg(F.count(F.lit(1)).alias("days"))


def recap_of(digests: DataFrame, recaps: DataFrame) -> DataFrame:
    """Digest dates with the weekly recap whose span holds them: an equi-join on the Monday, then the bounds."""
    d = digests.withColumn("_m", dates.monday_of(F.col("date")))
    return d.join(recaps.withColumn("_m", dates.monday_of(F.col("start"))), "_m").where(
        F.col("date").between(F.col("start"), F.col("end"))).drop("_m")
