"""Queries: sources, sinks, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, urls
from ..operators import deals as dl
from ..operators import feed, firms, geo, industry, map_index, quality, rollups, search_index
from ..rules import industry_rule_table
from ..sources import advisers as adv_src
from ..sources import feeds, sinks
from ..streaming import jobs, store
from . import frames, shared
from .frames import table
from .oracle import _ZIP, NOW_TS, START, day, q, ts
from ..session import small_side
from .registry import big, job
from .registry import ts as sts

# ---------------------------------------------------------------- sources and sinks


@job("src_feed_xml", q("art", "SELECT id, 'https://outlet_'||o||'.example.com/Deals/'||k||'?id='||k AS canonical_url, title, "
                       "CASE WHEN o=5 THEN '' ELSE description END AS description, "
                       f"{ts('published_at')} AS published_at, source FROM art"))
def _(spark, sf):
    a = frames.articles(spark, sf)
    rfc = F.concat(F.date_format("published_at", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    e = a.select("id", F.concat(F.col("title"), F.lit(" | "), F.col("source")).alias("title"), F.col("url").alias("link"),
                 rfc.alias("date"), F.concat(F.lit("<p>"), F.col("description"), F.lit("</p>")).alias("description"),
                 F.lit(None).cast("string").alias("content"), "source", "fetched_at")
    i = feeds.to_items(e, F.col("fetched_at").cast("timestamp"), F.col("source"), F.col("source") == "outlet_5")
    return i.select((F.regexp_extract("canonical_url", r"id=(\d+)", 1).cast("bigint") * 10
                     + F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")).alias("id"),
                    "canonical_url", "title", "description", sts("published_at").alias("published_at"), "source")


@job("src_feed_valid", "SELECT count(*) AS files, count_if(regexp_matches(html, '(?i)^<(rss|feed)[\\s>]')) AS feeds FROM pages")
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("html").rlike(r"(?i)^<(?:rss|feed|rdf:RDF)[\s>]")).alias("feeds"))


def _page_as_listing(spark, sf):
    """Each article heading of a page as an anchor of a listing page on the same host."""
    p = table(spark, sf, "pages")
    heading = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    html = F.concat(F.lit("<html><nav><h2><a href='/news/menu-entry-one'>Menu entry that must be left out</a></h2></nav><article><h2><a href=\"/news/item-"),
                    F.col("page_id").cast("string"), F.lit("?utm_source=x\">"), heading, F.lit("</a></h2></article>"),
                    F.lit("<article><a href='/tag/deals/2020/10/'>Skipped because of its path here</a></article></html>"))
    return p.select("page_id", "url", heading.alias("heading"), html.alias("html"))


@job("src_listing_links",
     "WITH h AS (SELECT page_id, url, regexp_extract(html,'<h1>(.*?)</h1>',1,'s') AS t0 FROM pages), c AS (SELECT page_id, url, "
     "trim(regexp_replace(replace(regexp_replace(t0,'<[a-zA-Z/!?][^>]*>',' ','gs'),'&amp;','&'),'\\s+',' ','g')) AS title FROM h) "
     "SELECT page_id, 1 AS n, lower(regexp_extract(url,'^(https?://[^/?#]+)',1))||'/news/item-'||page_id AS canonical_url, title FROM c "
     "WHERE length(title) BETWEEN 20 AND 220 AND length(title)-length(replace(title,' ',''))>=3")
def _(spark, sf):
    return feeds.listing_links(_page_as_listing(spark, sf)).select("page_id", "n", "canonical_url", "title")


@job("src_alternate_links", "SELECT page_id, regexp_extract(url,'^(https?://[^/?#]+)',1)||'/feed/'||page_id AS href FROM pages")
def _(spark, sf):
    p = table(spark, sf, "pages")
    head = F.concat(F.lit("<link rel='alternate' type='application/rss+xml' title='News' href='/feed/"), F.col("page_id").cast("string"),
                    F.lit("'><link rel='alternate' type='application/rss+xml' title='Comments' href='/comments/feed'>"
                          "<link rel='stylesheet' type='text/css' href='/x.css'>"))
    return feeds.alternate_links(p.select("page_id", "url", F.concat(head, F.col("html")).alias("html"))).select("page_id", "href")


@job("src_gnews_attribution",
     q("art", "SELECT source AS outlet, count_if(k%3=0) AS skipped, count(DISTINCT CASE WHEN k%3<>0 THEN strftime(published_at,'%Y-%m-%d')"
       "||trim(regexp_replace(lower(title),'[^a-z0-9]+',' ','g')) END) AS kept FROM art GROUP BY 1"))
def _(spark, sf):
    a = frames.articles(spark, sf)
    o = F.col("source")
    e = a.select(F.concat(F.col("title"), F.lit(" - "), o).alias("title"), sts("published_at").alias("date"), o.alias("origin"), "fetched_at",
                 "source", F.when(F.col("deal_key") % 3 == 0, F.lit("https://elsewhere.example.org")).when(
                     F.col("deal_key") % 3 == 1, F.concat(F.lit("https://news."), o, F.lit(".example.com"))).otherwise(
                     F.concat(F.lit("https://www."), o, F.lit(".example.com"))).alias("origin_url"))
    r = feeds.attributed(e, F.col("source"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com")),
                         F.col("fetched_at").cast("timestamp"), zone="UTC")
    return feeds.attribution_counts(r)


@job("src_adviser_file",
     q("adv", "SELECT crd, upper(base)||' WEALTH INC.' AS legal_name, base||' Wealth' AS business_name, state, aum_usd, lpad(CAST((n*37)%100000 "
       "AS VARCHAR),5,'0') AS zip FROM adv WHERE n%5<>0"))
def _(spark, sf):
    a = frames.advisers(spark, sf)
    base, n = F.split("business_name", " ")[0], F.col("crd").cast("bigint")
    raw = a.select(
        F.concat(F.col("crd"), F.when(n % 2 == 0, ".0").otherwise("")).alias("c0"),
        F.concat(F.when(n % 5 == 0, "802-").otherwise("801-"), F.col("crd")).alias("c1"),
        F.concat(F.upper(base), F.lit(" WEALTH INC.")).alias("c2"), F.concat(base, F.lit(" Wealth")).alias("c3"),
        F.lower("state").alias("c4"), F.concat(F.lit("$"), F.col("aum_usd").cast("decimal(20,0)").cast("string")).alias("c5"),
        F.concat(F.lpad(((n * 37) % 100000).cast("string"), 5, "0"), F.lit("-1234")).alias("c6"))
    heads = {"c0": "Organization CRD#", "c1": "SEC#", "c2": "Legal Name", "c3": "Primary Business Name", "c4": "Main Office State",
             "c5": "5F(2)(c)", "c6": "Main Office Postal Code"}
    return adv_src.advisers_from_table(raw, heads, frames.SEC_DATE).select("crd", "legal_name", "business_name", "state", "aum_usd", "zip")


@job("src_adviser_latest", "SELECT max(CAST(o_orderdate AS DATE)) AS data_date FROM orders WHERE o_orderkey%3=0")
def _(spark, sf):
    o = table(spark, sf, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("https://files.example.gov/ia"), F.when(k % 2 == 0, F.date_format(d, "MMddyyyy")).otherwise(
        F.date_format(d, "yyyyMMdd")), F.lit(".zip"))).otherwise(F.concat(F.lit("https://files.example.gov/ia-exempt-"), F.date_format(
            d, "yyyyMMdd"), F.lit(".zip")))
    return adv_src.latest_file(o.select(name.alias("name"))).select("data_date")


@job("src_zip_gazetteer", "WITH " + _ZIP + " SELECT zip, round(lat,4) AS lat, round(lon,4) AS lon FROM zp")
def _(spark, sf):
    k = F.col("p_partkey")
    raw = table(spark, sf, "part").groupBy(((k * 74) % 100000).cast("string").alias("GEOID")).agg(
        F.min(F.lit(30.0) + (k * 7919 % 1500) / 100).cast("string").alias("INTPTLAT"),
        F.min(F.lit(-120.0) + (k * 104729 % 4000) / 100).cast("string").alias("INTPTLONG"))
    bad = raw.withColumn("GEOID", F.concat(F.lit("x"), F.col("GEOID")))
    return adv_src.zip_rows(raw.unionByName(bad)).select("zip", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@job("src_rules", q("it", "SELECT industry, 'x'||count(*) AS items FROM it GROUP BY 1"))
def _(spark, sf):
    rules = industry_rule_table(spark)
    n = industry.counts(shared.items_once(spark, sf))
    return n.join(small_side(rules), "industry").select("industry", F.concat(F.lit("x"), F.col("n").cast("string")).alias("items"))


@job("sink_public_docs", q("cl", "SELECT CAST(cluster_id AS VARCHAR) AS key, '{\"cluster_id\":'||cluster_id||',\"headline\":\"'||headline||'\"}' AS doc FROM cl"))
def _(spark, sf):
    path = f"{jobs.work_folder(spark)}/docs"
    sinks.write_docs(shared.stories_once(spark, sf), ["cluster_id", "headline"], "cluster_id", path)
    return spark.read.schema("key string, doc string").json(path)


@job("sink_detail_shards", q("adv", "SELECT n%32 AS shard, count(*) AS n, count(DISTINCT n) AS advisers FROM adv GROUP BY 1"))
def _(spark, sf):
    path = f"{jobs.work_folder(spark)}/shards"
    sinks.write_shards(frames.advisers(spark, sf), path)
    return spark.read.schema("crd string, shard int").json(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("crd").alias("advisers"))


@job("sink_wire_stats", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("ts", "run_at")
    path = f"{jobs.work_folder(spark)}/stats"
    half = e.where("day(run_at) <= 15 and event_id % 2 = 0")
    sinks.write_stats(half, path)
    sinks.write_stats(e, path)  # its dates replace those of the first run
    return sinks.live_stats(spark, path, F.lit("2024-01-20").cast("date"), 10).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@job("sink_replace_dimension", q("adv", "SELECT count(*) AS n, count_if(n%2=0) AS even FROM adv"))
def _(spark, sf):
    new = frames.advisers(spark, sf).select("crd", "legal_name", "aum_usd")
    path = f"{jobs.work_folder(spark)}/advisers"
    sinks.replace_dimension(new.where("crd % 2 = 0"), path, 10)
    sinks.replace_dimension(new, path, 10)
    sinks.replace_dimension(new.where("crd = '0'"), path, 10)  # too small a load: the version before stays
    return sinks.read_dimension(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("crd").cast("bigint") % 2 == 0).alias("even"))


@job("sink_source_status",
     "SELECT 'outlet_'||c AS name, CASE WHEN c%2=0 THEN 'https://new/'||c ELSE 'https://old/'||c END AS discovered_url, CAST(n AS BIGINT) AS items_last_run "
     "FROM (SELECT l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY 1)")
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("items_last_run"))
    c = F.col("l_linenumber")
    name = F.format_string("outlet_%d", c.cast("int")).alias("name")
    new = n.select(name, F.when(c % 2 == 0, F.concat(F.lit("https://new/"), c.cast("string"))).otherwise("").alias("discovered_url"), "items_last_run")
    old = n.select(name, F.concat(F.lit("https://old/"), c.cast("string")).alias("discovered_url"), F.lit(0).cast("bigint").alias("items_last_run"))
    return rollups.upsert_status(old, new)


# ---------------------------------------------------------------- filters and projections
@job("filter_deal_headlines", q("art", "SELECT source, count(*) AS seen, count_if(kind<6) AS kept, count_if(kind>=6) AS dropped FROM art GROUP BY 1"))
def _(spark, sf):
    return dl.is_deal_counts(frames.articles(spark, sf))


@job("filter_reject_reason", q("art", "SELECT CASE kind WHEN 6 THEN 'commentary' WHEN 7 THEN 'not_a_deal' ELSE 'deal' END AS reason, count(*) AS n FROM art GROUP BY 1"))
def _(spark, sf):
    r = dl.classify_reason(frames.articles(spark, sf))
    return r.groupBy(F.coalesce("reason", F.lit("deal")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@job("filter_max_age", q("art", f"SELECT source, count(*) AS n FROM art WHERE o>2 OR published_at >= {NOW_TS} - INTERVAL 3 DAY GROUP BY 1"))
def _(spark, sf):
    kept = feeds.within_age(frames.articles(spark, sf), frames.source_config(spark, sf), frames.now())
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@job("filter_registered_only", q("adv", "SELECT CAST(n AS VARCHAR) AS crd FROM adv WHERE n%3<>1 AND n%7<>2"))
def _(spark, sf):
    a, n = frames.advisers(spark, sf), F.col("crd").cast("bigint")
    a = a.withColumn("sec_number", F.when(n % 3 == 1, F.concat(F.lit("802-"), "crd")).when(n % 3 == 0, F.col("sec_number")))
    a = a.withColumn("crd", F.when(n % 7 == 2, F.concat(F.lit("x"), "crd")).otherwise(F.col("crd")))
    return adv_src.registered_only(a).select("crd")


@job("filter_exclude_sources", q("it", "SELECT min(id) AS cluster_id, count(DISTINCT source) AS outlet_count, arg_min(title, o) AS headline FROM it WHERE o<>6 GROUP BY k"))
def _(spark, sf):
    ex = spark.createDataFrame([(s,) for s in frames.EXCLUDED], "source string")
    r = rollups.cluster_rollup(rollups.without_sources(shared.items_once(spark, sf), ex))
    return r.select("cluster_id", "outlet_count", "headline")


@job("filter_feed_query", q("cl", f"SELECT cluster_id FROM cl WHERE industry='Industrials' AND {day('last_published')} >= DATE '1998-01-01' AND "
                            f"{day('first_published')} <= DATE '1999-12-31' AND lower(acquirer) LIKE 'b%'"))
def _(spark, sf):
    query = feed.FeedQuery(industries=("Industrials",), day_from="1998-01-01", day_to="1999-12-31")
    out = feed.filter_feed(shared.snapshot(spark, sf, firms=False, subjects=False), query)
    return out.where(F.lower("deal.acquirer").like("b%")).select(F.col("id").alias("cluster_id"))


@job("feed_prefix_search", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_$&.''-]+')) AS w FROM documents) SELECT doc_id FROM w GROUP BY 1 "
     "HAVING bool_or(starts_with(w,'a')) AND bool_or(starts_with(w,'th')) AND bool_or(starts_with(w,'1'))")
def _(spark, sf):
    """Documents with words that start with each of four terms, by an index over all of them; one term implies another."""
    path = jobs.work_folder(spark)
    search_index.write_index(table(spark, sf, "documents"), feed.words_in(F.col("text")), path, "doc_id")
    return search_index.find(spark, path, feed.query_terms("A th, t 1")).select(F.col("id").alias("doc_id"))


@job("filter_region", q("cl adv", "SELECT cluster_id FROM cl WHERE EXISTS (SELECT 1 FROM adv WHERE n IN (acq_crd, tgt_crd) AND state IN ('WA','OR','ID'))"))
def _(spark, sf):
    out = feed.filter_feed(shared.snapshot(spark, sf), feed.FeedQuery(region="Pacific Northwest"))
    return out.select(F.col("id").alias("cluster_id"))


@job("filter_deals_query", q("cl", "SELECT cluster_id, stage FROM cl WHERE industry='Real Estate'"))
def _(spark, sf):
    return feed.filter_deals(shared.deals(spark, sf), "high", ("Real Estate",)).select("cluster_id", "stage")


@job("filter_map_advisers", q("adv", "SELECT n AS crd FROM adv WHERE aum_usd>=1e9 AND (n+2)%3=0 AND NOT abroad", "x AS (SELECT 1)"))
def _(spark, sf):
    rows = frames.advisers(spark, sf).where("country = 'United States'").select(
        F.col("crd").cast("bigint").alias("crd"), "aum_usd", geo.bit_mask(F.col("profile.services")).alias("services"), F.lit(0).alias("flags"),
        geo.client_focus(F.col("profile.client_aum")).alias("focus"))
    return geo.map_filter(rows, min_aum=1_000_000_000, service=2).select("crd")


@job("filter_map_viewport", "SELECT count(*) AS advisers, CAST(sum(s_acctbal) AS DOUBLE) AS total FROM supplier WHERE s_suppkey%975 BETWEEN 100 AND 600 AND s_suppkey*7%610 BETWEEN 50 AND 400")
def _(spark, sf):
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 975).cast("double").alias("x"), (F.col("s_suppkey") * 7 % 610).cast("double").alias("y"),
                                            F.col("s_acctbal").alias("aum_usd"))
    path = jobs.work_folder(spark)
    map_index.write_map(s, path)
    t = geo.viewport_totals(map_index.box(spark, path, 100, 50, 600, 400))
    return t.select("advisers", F.col("aum_usd").alias("total"))


@job("filter_window_candidates", q("cl", f"SELECT cluster_id FROM cl WHERE first_seen > {START} AND last_published >= {START} - INTERVAL 2 DAY"))
def _(spark, sf):
    start = feed.window_start(F.lit(frames.PREVIOUS).cast("timestamp"), frames.now())
    return feed.window_candidates(shared.stories(spark, sf), start).select("cluster_id")


@job("filter_trending_verified", q("lk", "SELECT count(*) AS pairs, count(DISTINCT crd) AS firms FROM (SELECT DISTINCT k, crd FROM lk)"))
def _(spark, sf):
    return shared.story_crds(spark, sf).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("crd").alias("firms"))


@job("proj_public_item", q("cl", "SELECT cluster_id, headline, industry AS category, acquirer, target, outlet_count FROM cl"))
def _(spark, sf):
    s = shared.snapshot(spark, sf)
    return s.select(F.col("id").alias("cluster_id"), "headline", "category", F.col("deal.acquirer").alias("acquirer"),
                    F.col("deal.target").alias("target"), big("outlet_count").alias("outlet_count"))


_MASK = "+".join(f"CASE WHEN (n+{i})%3=0 THEN {1 << (i - 1)} ELSE 0 END" for i in range(1, 13))
_FOCUS = ("CASE WHEN ma+mb+mf+mg+mm<=0 THEN 3 WHEN ma+mb>=mf AND ma+mb>=mg+mm THEN 0 WHEN mf>=mg+mm THEN 1 ELSE 2 END")


@job("proj_map_compact", q("adv", f"SELECT n AS crd, name, CAST(coalesce(aum_usd,0) AS BIGINT) AS aum_usd, city, state, {_FOCUS} AS focus, {_MASK} AS services FROM adv, ids WHERE crd=id",
                           _ZIP + ", ids AS (SELECT a2.crd AS id FROM (SELECT crd, zip, abroad FROM adv) a2 WHERE NOT abroad AND (zip IN (SELECT zip FROM zp) OR substr(zip,1,3) IN (SELECT substr(zip,1,3) FROM zp)))"))
def _(spark, sf):
    return shared.map_rows(spark, sf).select("crd", "name", "aum_usd", "city", "state", "focus", "services")


@job("proj_display_name", q("adv", "SELECT crd, name AS display, name AS legal FROM adv"))
def _(spark, sf):
    return frames.advisers(spark, sf).select("crd", firms.pretty_name(F.col("business_name")).alias("display"),
                                             firms.pretty_name(F.col("legal_name")).alias("legal"))


@job("proj_slug", q("adv", "SELECT crd, lower(base)||'-capital-partners-'||crd AS slug FROM adv"))
def _(spark, sf):
    return rollups.firm_view(frames.advisers(spark, sf)).select("crd", "slug")


# ---------------------------------------------------------------- joins
@job("join_dictionary", q("art", "SELECT id, CAST(o_custkey*2 AS VARCHAR) AS crd FROM art UNION ALL SELECT id, CAST(suppkey*2+1 AS VARCHAR) FROM art WHERE kind<>6"))
def _(spark, sf):
    return firms.dictionary_hits(frames.articles(spark, sf).select("id", "title"), "id", "title", shared.dictionary(spark, sf)).select("id", "crd")


@job("join_items_clusters", q("it", "SELECT id, cluster_id, deal_type, industry AS category FROM it"))
def _(spark, sf):
    it = shared.items(spark, sf)
    s = shared.stories(spark, sf).select("component", "cluster_id", F.get("industries", F.lit(0)).alias("category"))
    return it.select("id", "component", F.col("deal.deal_type").alias("deal_type")).join(s, "component").drop("component")


@job("join_adviser_dimension", q("lk adv", "SELECT id, lk.crd, city, state FROM lk JOIN adv ON adv.n=lk.crd"))
def _(spark, sf):
    view = rollups.firm_view(frames.advisers(spark, sf)).select("crd", "city", "state")
    return shared.item_links(spark, sf).join(view, "crd", "left").select("id", F.col("crd").cast("bigint").alias("crd"), "city", "state")


@job("join_party_link", q("cl", "SELECT cluster_id, CAST(acq_crd AS VARCHAR) AS acquirer_crd, CAST(tgt_crd AS VARCHAR) AS target_crd FROM cl"))
def _(spark, sf):
    return shared.deals(spark, sf).select("cluster_id", "acquirer_crd", "target_crd")


@job("join_curated_alias", q("adv", "SELECT base AS alias, CASE WHEN n%2=0 THEN crd END AS crd FROM adv"))
def _(spark, sf):
    a = frames.advisers(spark, sf)
    even = F.col("crd").cast("bigint") % 2 == 0
    curated = a.select(F.split("business_name", " ")[0].alias("alias"), F.when(even, F.col("legal_name")).otherwise("No such adviser").alias("target"))
    return firms.resolve_curated(curated, a).select("alias", "crd")


_LOC = "SELECT crd, CASE WHEN z.zip IS NOT NULL THEN 'exact' ELSE 'zip3' END AS placed_by, round(coalesce(z.lat, z3.lat),6) AS lat, round(coalesce(z.lon, z3.lon),6) AS lon FROM adv LEFT JOIN zp z USING (zip) LEFT JOIN z3 ON z3.zip3=substr(adv.zip,1,3) WHERE NOT abroad AND coalesce(z.lat, z3.lat) IS NOT NULL"
_Z3 = "z3 AS (SELECT substr(zip,1,3) AS zip3, avg(lat) AS lat, avg(lon) AS lon FROM zp GROUP BY 1)"


@job("join_zip_exact_fallback", q("adv", _LOC, _ZIP, _Z3))
def _(spark, sf):
    l = geo.locate(frames.advisers(spark, sf), frames.zip_points(spark, sf)).where("lat is not null")
    return l.select("crd", "placed_by", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@job("join_firm_deals", q("cl", "SELECT cluster_id, lower(acquirer)||'-capital-partners-'||acq_crd AS slug, 'acquirer' AS role FROM cl UNION ALL "
                          "SELECT cluster_id, lower(target)||'-capital-partners-'||tgt_crd, 'target' FROM cl"))
def _(spark, sf):
    return rollups.firm_deals(shared.linked_deals(spark, sf)).select("cluster_id", "slug", "role")


@job("join_adviser_recent_deals", q("cl", f"SELECT CAST(crd AS VARCHAR) AS crd, bool_or(first_published >= {NOW_TS} - INTERVAL 14 DAY) AS recent, least(count(*),3) AS n FROM "
                                    "(SELECT acq_crd AS crd, first_published FROM cl UNION ALL SELECT tgt_crd, first_published FROM cl) GROUP BY 1"))
def _(spark, sf):
    r = geo.recent_deals(shared.deals(spark, sf), frames.now())
    return r.groupBy("crd").agg(F.bool_or("recent").alias("recent"), F.count(F.lit(1)).alias("n"))


def _watchlist(spark, sf):
    """Watch every brand of a customer of the first nation, plus its adviser name."""
    a = frames.advisers(spark, sf).where("city = 'CITY 0'")
    return a.select(F.split("business_name", " ")[0].alias("name"), F.array("business_name").alias("aliases"))


@job("join_watchlist_terms", q("art adv", "SELECT id, base AS name FROM art JOIN adv ON nation=0 AND ((n=o_custkey*2) OR (n=suppkey*2+1 AND kind<>6))"))
def _(spark, sf):
    terms = firms.watch_terms(_watchlist(spark, sf))
    return firms.watch_hits(frames.articles(spark, sf), "id", "title", terms)


@job("join_watchlist_names", q("adv", "SELECT base AS name, crd FROM adv WHERE nation=0"))
def _(spark, sf):
    return firms.watch_advisers(firms.watch_terms(_watchlist(spark, sf)), frames.advisers(spark, sf))


@job("join_recap_interval", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) SELECT strftime(date,'%Y-%m-%d') AS date, strftime(date,'%G-W%V') AS week FROM d "
     "WHERE isodow(date)<=5")
def _(spark, sf):
    d = table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    recaps = d.select(dates.monday_of(F.col("date")).alias("start")).distinct().withColumn("end", F.date_add("start", 4)).withColumn(
        "week", dates.iso_week(F.col("start")))
    return feed.recap_of(d, recaps).select(F.col("date").cast("string").alias("date"), "week")


@job("semi_firms_in_dictionary", q("art adv", "SELECT crd FROM adv WHERE n IN (SELECT o_custkey*2 FROM art) OR n IN (SELECT suppkey*2+1 FROM art WHERE kind<>6)"))
def _(spark, sf):
    hit = firms.dictionary_hits(frames.articles(spark, sf).select("id", "title"), "id", "title", shared.dictionary(spark, sf))
    used = firms.alias_rows(frames.advisers(spark, sf)).join(hit.select("alias").distinct(), "alias", "left_semi").select("crd").distinct()
    return frames.advisers(spark, sf).join(used, "crd", "left_semi").select("crd")


@job("anti_new_items", q("art", "SELECT id FROM art WHERE o<>3"))
def _(spark, sf):
    a = frames.articles(spark, sf).withColumn("canonical_url", urls.canonical_url(F.col("url")))
    items = store.ItemStore(spark, f"{jobs.work_folder(spark)}/items", "canonical_url")
    items.insert(a.where("source = 'outlet_3'"), 0)
    items.insert(a.unionByName(a), 1)
    return items.items(batch=1).select("id")


@job("semi_private_text", "SELECT doc_id, item_id FROM documents JOIN benchmark ON length(trim(benchmark.text))>=40 AND contains(documents.text, trim(benchmark.text))")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("private_id"), F.col("text").alias("ptext"))
    r = quality.private_overlap(table(spark, sf, "documents"), "doc_id", "text", b, "ptext")
    return r.select("doc_id", F.col("private_id").alias("item_id"))


