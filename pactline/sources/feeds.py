"""Landed feeds and pages -> item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions.hof import let, positions
from ..session import small_side
from ..functions.text import (clean_description, clean_title, html_text, squash, strip_outlet_suffix, strip_source_suffix,
                              unescape)

ITEM_COLUMNS = ("title", "url", "canonical_url", "source", "published_at", "published_estimated", "fetched_at", "description")
_RSS = ("title string, link string, pubDate string, description string, `content:encoded` string, `dc:date` string, "
        "source struct<_VALUE:string,_url:string>")
_ATOM = "title string, link array<struct<_href:string,_rel:string>>, published string, updated string, summary string"


def read_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed RSS and Atom files: one row per entry with its file name."""
    rss = spark.read.format("xml").option("rowTag", "item").schema(_RSS).load(path).select(
        F.col("_metadata.file_name").alias("file"), "title", F.trim("link").alias("link"), F.coalesce("pubDate", "`dc:date`").alias("date"),
        "description", F.col("`content:encoded`").alias("content"), F.col("source._VALUE").alias("origin"),
        F.col("source._url").alias("origin_url"))
    atom = spark.read.format("xml").option("rowTag", "entry").schema(_ATOM).load(path)
    alternate = F.filter("link", lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    atom = atom.select(
        F.col("_metadata.file_name").alias("file"), "title", F.trim(F.get(alternate, F.lit(0))["_href"]).alias("link"),
        F.coalesce("published", "updated").alias("date"), F.col("summary").alias("description"), F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("origin_url"))
    return rss.unionByName(atom)


def feed_validity(spark: SparkSession, path: str) -> DataFrame:
    """(file, is_feed): the root element is a feed element."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    body = F.regexp_replace("value", r"(?s)^\s*(?:\x{FEFF})?(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*", "")
    return raw.select("file", body.rlike(r"(?i)^<(?:rss|feed|rdf:RDF)[\s>]").alias("is_feed"))


def to_items(entries: DataFrame, fetched_at: Column, source: Column, gated: Column, zone: str = dates.LOCAL_ZONE) -> DataFrame:
    """Entry rows -> items: cleaned title and teaser, canonical address, sane publish time.

    Entries without a title or an http link are dropped; a teaser that repeats the full body is discarded, and gated
    outlets keep no teaser.
    """
    e = entries.withColumn("title", strip_source_suffix(clean_title(F.col("title")), source)).withColumn(
        "_row", F.monotonically_increasing_id()).where((F.col("_row") >= 0) &  # filters stay above the cleaning
        
        (F.col("title") != "") & F.col("link").rlike("^https?://"))
    when = dates.published_or_fetched(dates.parse_date(F.col("date"), zone), fetched_at)
    body = F.trim(F.coalesce("description", F.lit(""))) == F.trim(F.coalesce("content", F.lit("\u0000")))
    return e.withColumn("_when", when).select(
        "title", F.col("link").alias("url"), urls.canonical_url(F.col("link")).alias("canonical_url"), source.alias("source"),
        F.col("_when.at").alias("published_at"), F.col("_when.estimated").alias("published_estimated"),
        fetched_at.alias("fetched_at"),
        F.when(gated | body, F.lit("")).otherwise(clean_description(F.coalesce("description", F.lit("")))).alias("description"))


def attributed(entries: DataFrame, outlet: Column, homepage: Column, fetched_at: Column, zone: str = dates.LOCAL_ZONE) -> DataFrame:
    """Aggregator entries credited to one outlet. `keep` is false for entries of other outlets; the key of a kept entry
    is outlet, day and normalised headline."""
    want, got = urls.bare_host(homepage), urls.bare_host(F.coalesce("origin_url", F.lit("")))
    dot = F.lit(".")
    same = (want == "") | (got == "") | (got == want) | F.endswith(got, F.concat(dot, want)) | F.endswith(want, F.concat(dot, got))
    title = let(clean_title(F.col("title")), lambda t: let(strip_outlet_suffix(t, F.coalesce("origin", F.lit(""))), lambda first: F.when(
        first != t, first).otherwise(strip_outlet_suffix(t, outlet))))
    when = dates.published_or_fetched(dates.parse_date(F.col("date"), zone), fetched_at)
    e = entries.withColumn("keep", same).withColumn("_when", when).withColumn("title", title)
    return e.select("*", outlet.alias("outlet"), attribution_key(outlet, F.col("_when.at"), F.col("title")).alias("key"))


def attribution_key(outlet: Column, published: Column, title: Column) -> Column:
    norm = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))
    return F.concat_ws(":", F.lit("gnews"), F.lower(outlet), F.date_format(published, "yyyy-MM-dd"), norm)


def attribution_counts(rows: DataFrame, by: str = "outlet") -> DataFrame:
    """Per outlet: entries of others skipped and distinct keys kept."""
    return rows.groupBy(by).agg(F.count_if(~F.col("keep")).alias("skipped"),
                                F.countDistinct(F.when(F.col("keep"), F.col("key"))).alias("kept"))


# ---------------------------------------------------------------- pages
# fixed values: article-like paths, paths to skip, page parts that hold no articles, feed media types
ARTICLE_PATH = r"(?i)(?:/\d{4}/\d{1,2}/|/news/|/article|/story/|/\d{5,}|-[a-z0-9]+-[a-z0-9]+-[a-z0-9]+)"
SKIP_PATH = (r"(?i)/(?:tags?|category|categories|authors?|topics?|page|search|login|subscribe|events?|podcasts?|videos?|"
             r"webinars?)(?:/|$)")
_NO_CONTENT = r"(?is)<(script|style|nav|footer|header|aside|form|noscript)\b[^>]*>.*?</\1\s*>"
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/rdf+xml", "application/feed+json", "text/xml",
              "application/xml")
_BLOCK = r"(?is)<(article|h[1-4])\b[^>]*>.*?</\1\s*>|<a\b[^>]*\bhref\s*=[^>]*>(?:(?!</a).)*<h[23]\b.*?</a\s*>"
_ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>.*?</a\s*>"


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)^<[^>]*?\b{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return unescape(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def page_anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, pos, href, text) of anchors inside articles and headings, in page order."""
    blocks = F.regexp_extract_all(F.regexp_replace(html, _NO_CONTENT, " "), F.lit(_BLOCK), 0)
    anchors = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(_ANCHOR), 0)))
    a = pages.select(key, url, F.posexplode(anchors).alias("pos", "a"))
    return a.select(key, url, "pos", urls.absolute_url(F.col(url), _attribute(F.col("a"), "href")).alias("href"),
                    clean_title(F.regexp_replace("a", r"(?is)^<a\b[^>]*>|</a\s*>$", "")).alias("text"))


def listing_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", limit: int = 60,
                  min_chars: int = 20, max_chars: int = 220, min_words: int = 4, article_path: str = ARTICLE_PATH) -> DataFrame:
    """Headline links of listing pages: same host, article-like path, plausible headline, one per canonical address,
    at most `limit` per page in page order."""
    a = page_anchors(pages, key, url, html)
    p = urls.path(F.col("href"))
    ok = (F.col("href").rlike("^https?://") & (urls.host(F.col("href")) == urls.host(F.col(url))) & ~p.rlike(SKIP_PATH)
          & p.rlike(article_path) & F.length("text").between(min_chars, max_chars)
          & (F.size(F.split("text", r"\s+")) >= min_words))
    firsts = a.where(ok).withColumn("canonical_url", urls.canonical_url(F.col("href"))).groupBy(key, "canonical_url").agg(
        F.min_by(F.struct("pos", "href", "text"), "pos").alias("f"))
    w = Window.partitionBy(key).orderBy("f.pos")
    return firsts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(
        key, F.col("n").cast("int").alias("n"), "canonical_url", F.col("f.href").alias("href"), F.col("f.text").alias("title"))


def alternate_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, href) feed addresses advertised by pages, comment feeds left out, first mention only."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<link\b[^>]*>"), 0)
    t = pages.select(key, url, F.posexplode(tags).alias("pos", "t"))
    kind = F.trim(F.substring_index(F.lower(_attribute(F.col("t"), "type")), ";", 1))
    href = urls.absolute_url(F.col(url), _attribute(F.col("t"), "href"))
    ok = (F.array_contains(F.split(F.lower(_attribute(F.col("t"), "rel")), r"\s+"), "alternate") & kind.isin(*FEED_TYPES)
          & (_attribute(F.col("t"), "href") != "") & ~F.contains(F.lower(_attribute(F.col("t"), "title")), F.lit("comment"))
          & ~F.contains(href, F.lit("/comments/")))
    return t.where(ok).withColumn("href", href).groupBy(key, "href").agg(F.min("pos").alias("pos"))


def merge_feeds(items: DataFrame, feed_order: str, key: str = "canonical_url") -> DataFrame:
    """Several feeds of an outlet as one: the first feed that carries an address wins."""
    cols = [c for c in items.columns if c != key]
    first = items.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(feed_order)).alias("f"))
    return first.select(key, "f.*")


def new_only(items: DataFrame, stored: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Items whose address is not stored yet, one per address."""
    return items.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def within_age(items: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Drop items older than their outlet allows (0 = no limit)."""
    s = sources.select(F.col("name").alias("source"), "max_age_days")
    j = items.join(small_side(s), "source")
    return j.where((F.col("max_age_days") == 0) | (
        F.col("published_at") >= now - F.make_dt_interval(F.col("max_age_days")))).drop("max_age_days")
