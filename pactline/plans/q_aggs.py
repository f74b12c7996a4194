"""Queries: aggregations, windows, ranking, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import feed, firms, geo, industry, map_index, quality, rollups, wealth
from ..sources import advisers as adv_src
from ..sources import feeds
from ..streaming import jobs
from . import frames, shared
from .frames import table
from .oracle import _ZIP, MONDAY, NOW_TS, START, TODAY, day, q, ts
from .registry import job, joined
from .registry import ts as sts

_Z3 = "z3 AS (SELECT substr(zip,1,3) AS zip3, avg(lat) AS lat, avg(lon) AS lon FROM zp GROUP BY 1)"
_ON = "pl AS (SELECT adv.*, NOT abroad AND (z.zip IS NOT NULL OR z3.zip3 IS NOT NULL) AS mapped FROM adv LEFT JOIN zp z USING (zip) LEFT JOIN z3 ON z3.zip3=substr(adv.zip,1,3))"
_WEALTH = "Wealth Management & RIAs"

# ---------------------------------------------------------------- aggregations


@job("agg_cluster_rollup", q("cl", f"SELECT cluster_id, headline, {ts('first_seen')} AS first_seen, {ts('last_published')} AS last_published, outlet_count, item_count, industry AS industries FROM cl"))
def _(spark, sf):
    s = shared.stories_once(spark, sf)
    return s.select("cluster_id", "headline", sts("first_seen").alias("first_seen"), sts("last_published").alias("last_published"),
                    "outlet_count", "item_count", joined("industries").alias("industries"))


@job("agg_cluster_aum", q("cl", "SELECT k, aum_usd FROM cl"))
def _(spark, sf):
    return rollups.cluster_aum(shared.full_items(spark, sf)).select(F.col("component").alias("k"), "aum_usd")


@job("agg_registered_aum_fallback", q("cl adv", f"SELECT k, crd AS sec_aum_crd, adv.aum_usd AS sec_aum_usd FROM cl JOIN adv ON adv.n=subject WHERE subjects=1 AND cl.aum_usd IS NULL AND industry='{_WEALTH}' AND adv.aum_usd>0"))
def _(spark, sf):
    r = rollups.registered_aum(shared.full_items(spark, sf), frames.advisers(spark, sf))
    return r.select(F.col("component").alias("k"), "sec_aum_crd", "sec_aum_usd")


@job("agg_best_deal", q("cl", "SELECT cluster_id, acquirer, target, deal_type, stage, value_usd, press_release FROM cl"))
def _(spark, sf):
    b = rollups.best_deal(shared.items(spark, sf), frames.WIRES)
    return b.select("cluster_id", "best.acquirer", "best.target", "best.deal_type", "stage", "value_usd", "press_release")


@job("agg_target_aum_consensus", q("it", "SELECT k, CASE WHEN bool_or(kind<>0 OR seg<>'wealth management') THEN min(a) END AS acquirer, max(CASE WHEN kind=4 AND seg='wealth management' THEN price END) AS target_aum_usd FROM it WHERE seg='wealth management' GROUP BY k HAVING bool_or(kind<>0)"))
def _(spark, sf):
    w = wealth.parse_wealth(shared.items(spark, sf).where(F.array_contains("industries", F.lit(_WEALTH))))
    t = rollups.target_aum(w, frames.WIRES).where("confidence = 'high'")
    return t.select(F.col("component").alias("k"), "acquirer", "target_aum_usd")


@job("agg_industry_union", "SELECT o_custkey, string_agg(m, '|' ORDER BY r) AS industries FROM (SELECT DISTINCT o_custkey, CASE o_orderkey%3 WHEN 0 THEN 'Banking' WHEN 1 THEN 'Technology' ELSE 'Insurance' END AS m, "
     "CASE o_orderkey%3 WHEN 0 THEN 3 WHEN 1 THEN 8 ELSE 4 END AS r FROM orders) GROUP BY 1")
def _(spark, sf):
    k = F.col("o_orderkey") % 3
    o = table(spark, sf, "orders").select("o_custkey", F.array(F.when(k == 0, "Banking").when(k == 1, "Technology").otherwise("Insurance"), F.lit("Other")).alias("tags"))
    return o.groupBy("o_custkey").agg(joined(industry.union_of(F.collect_set("tags"))).alias("industries"))


@job("agg_trending", q("cl lk", f"SELECT CAST(crd AS VARCHAR) AS crd, count(DISTINCT k) AS stories, min(name) AS name FROM lk JOIN (SELECT k FROM cl WHERE last_published >= {NOW_TS} - INTERVAL 365 DAY) USING (k) GROUP BY crd "
                       "ORDER BY count(DISTINCT k) DESC, lower(min(name)), CAST(crd AS VARCHAR) LIMIT 15"))
def _(spark, sf):
    return rollups.trending(*shared.recent_firms(spark, sf, 365), frames.now(), days=365)


_WK = f"wk AS (SELECT *, CASE WHEN seg='wealth management' THEN aum_usd END AS taum FROM cl WHERE {day('first_published')} BETWEEN {MONDAY} AND {TODAY})"


@job("agg_weekly_recap", q("cl", f"SELECT strftime({TODAY},'%G-W%V') AS week, CAST({MONDAY} AS VARCHAR) AS start, CAST({TODAY} AS VARCHAR) AS \"end\", count(*) AS deals, sum(taum) AS total_disclosed_aum_usd, "
                           "count(taum) AS disclosed_aum_deals, sum(value_usd) AS total_disclosed_value_usd, count(value_usd) AS disclosed_value_deals FROM wk", _WK))
def _(spark, sf):
    return rollups.weekly_totals(shared.deals_among(spark, sf, lambda d: rollups.week_rows(d, frames.now())), frames.now())


@job("agg_weekly_industry_counts", q("cl", f"SELECT CAST(CAST(date_trunc('week',{day('first_published')}) AS DATE) AS VARCHAR) AS monday, industry, count(*) AS deals FROM cl GROUP BY 1,2"))
def _(spark, sf):
    d = shared.deal_rows_once(spark, sf).select(dates.monday_of(dates.local_day(F.col("deal_date"))).cast("string").alias("monday"), F.explode("industries").alias("industry"))
    return d.groupBy("monday", "industry").agg(F.count(F.lit(1)).alias("deals"))


@job("agg_weekly_top_acquirers", q("cl", "SELECT CAST(acq_crd AS VARCHAR) AS k, count(*) AS deals, min(acquirer) AS name FROM cl GROUP BY 1 ORDER BY count(*) DESC, lower(min(acquirer)), 1 LIMIT 5"))
def _(spark, sf):
    return rollups.weekly_top_acquirers(shared.linked_deals(spark, sf))


@job("agg_industry_facets", q("cl", f"SELECT industry, count(*) AS n, count_if({day('last_published')} >= {TODAY} - 400) AS n_recent FROM cl GROUP BY 1"))
def _(spark, sf):
    return feed.industry_facets(shared.stories(spark, sf), frames.now(), days=400)


@job("agg_feed_summary", q("cl it adv", "SELECT (SELECT count(*) FROM cl) AS stories, (SELECT count(DISTINCT source) FROM it) AS outlets, "
                           "(SELECT count(DISTINCT state) FROM adv WHERE n IN (SELECT acq_crd FROM cl UNION ALL SELECT tgt_crd FROM cl)) AS states"))
def _(spark, sf):
    states = rollups.firm_view(frames.advisers(spark, sf)).select("crd", "state")
    return feed.whole_feed_summary(shared.slim_items(spark, sf), shared.story_crds(spark, sf), states)


def _status(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("items_last_run"))
    c = F.col("l_linenumber")
    return n.select(F.format_string("outlet_%d", c.cast("int")).alias("name"), (c != 4).alias("ok"), F.lit("RSS").alias("method"), "items_last_run",
                    F.lit(1).cast("bigint").alias("new_last_run"), F.lit(2).cast("bigint").alias("dropped_last_run"))


_HEALTH = ("hl AS (SELECT 'outlet_'||c AS name, c<>7 AND c<>4 AS ok, CASE WHEN c=7 THEN 'disabled' ELSE 'RSS' END AS method, CASE WHEN c=7 THEN 0 ELSE n END AS items_last_run "
           "FROM (SELECT l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY 1))")


@job("agg_sources_health", f"WITH {_HEALTH} SELECT * FROM hl")
def _(spark, sf):
    return rollups.sources_health(frames.source_config(spark, sf), _status(spark, sf)).select("name", "ok", "method", "items_last_run")


@job("agg_wire_stats", q("art", f"SELECT source, count(*) AS fetched, count_if(published_at >= {NOW_TS} - INTERVAL 700 DAY AND kind>=6) AS dropped_by_filter, "
                         f"count_if(published_at >= {NOW_TS} - INTERVAL 700 DAY AND kind<6) AS kept, count_if(published_at < {NOW_TS} - INTERVAL 700 DAY) AS too_old FROM art GROUP BY 1"))
def _(spark, sf):
    from ..operators.deals import parse_deals

    a = parse_deals(frames.articles(spark, sf), keep_rejects=True)
    rows = a.select("source", (F.col("published_at") >= frames.now() - F.make_dt_interval(F.lit(700))).alias("fresh"), F.col("deal").isNotNull().alias("is_deal"))
    return rollups.wire_stats(rows)


@job("agg_dataset_counts", q("cl it", "SELECT (SELECT count(*) FROM it) AS stories, (SELECT count(*) FROM cl) AS clusters, (SELECT count(*) FROM cl) AS deals, "
                             "(SELECT count(DISTINCT c) FROM (SELECT acq_crd AS c FROM cl UNION ALL SELECT tgt_crd FROM cl)) AS firms"))
def _(spark, sf):
    return shared.dataset_counts(spark, sf)


@job("agg_zip3_centroid", f"WITH {_ZIP}, {_Z3} SELECT zip3, round(lat,6) AS lat, round(lon,6) AS lon FROM z3")
def _(spark, sf):
    return geo.zip3_centroids(frames.zip_points(spark, sf)).select("zip3", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@job("agg_map_totals", q("adv", "SELECT count(*) AS advisers, count_if(mapped) AS mapped, count_if(NOT mapped) AS unmapped, count_if(mapped AND approx) AS approximate, 0 AS no_address, "
                         "sum(CASE WHEN mapped THEN coalesce(aum_usd,0) END) AS total_aum_usd FROM pl", _ZIP, _Z3, _ON))
def _(spark, sf):
    return geo.map_totals(frames.advisers(spark, sf), frames.zip_points(spark, sf))


@job("agg_client_mix", q("adv", "SELECT crd, code, pct FROM (SELECT *, row_number() OVER (PARTITION BY crd ORDER BY v DESC, code) AS rn FROM (SELECT crd, code, v, CAST(round_even(100*v/(ma+mb+mf+mg+mm),0) AS INT) AS pct "
                         "FROM adv, LATERAL (VALUES ('a',ma),('b',mb),('f',mf),('g',mg),('m',mm)) t(code,v) WHERE v>0) WHERE pct>=1) WHERE rn<=6"))
def _(spark, sf):
    return geo.client_mix(frames.advisers(spark, sf)).select("crd", "code", "pct")


@job("agg_client_focus", q("adv", "SELECT crd, CASE WHEN ma+mb+mf+mg+mm<=0 THEN 3 WHEN ma+mb>=mf AND ma+mb>=mg+mm THEN 0 WHEN mf>=mg+mm THEN 1 ELSE 2 END AS focus FROM adv"))
def _(spark, sf):
    return frames.advisers(spark, sf).select("crd", geo.client_focus(F.col("profile.client_aum")).alias("focus"))


def _shared_names(spark, sf):
    """Advisers named after the nation of the supplier or customer, so that aliases are shared."""
    a = frames.advisers(spark, sf)
    n = F.col("crd").cast("bigint")
    shared_name = F.concat(F.lit("Qvrtzk"), F.split("city", " ")[1])
    return a.withColumn("business_name", F.when(n % 4 == 0, F.concat(shared_name, F.lit(" Wealth Partners"))).otherwise(
        F.concat(shared_name, F.lit(" Advisors")))).withColumn("legal_name", F.col("business_name"))


@job("agg_alias_owner", q("adv", "SELECT 'qvrtzk'||nation AS alias, arg_max(crd, coalesce(aum_usd,0)::DOUBLE * 1000 + 0) AS crd FROM adv GROUP BY nation", "x AS (SELECT 1)"))
def _(spark, sf):
    o = firms.alias_owners(_shared_names(spark, sf)).where("n = 1 and crd is not null")
    return o.select("alias", "crd")


@job("agg_alias_dominance", q("adv", "SELECT 'qvrtzk'||nation AS alias, sum(coalesce(aum_usd,0)) AS all_aum, max(coalesce(aum_usd,0)) AS top_aum, max(coalesce(aum_usd,0))>=0.85*sum(coalesce(aum_usd,0)) AS dominant "
                              "FROM adv GROUP BY nation HAVING sum(coalesce(aum_usd,0))>0"))
def _(spark, sf):
    return firms.alias_dominance(_shared_names(spark, sf)).where(~F.contains("alias", F.lit(" "))).select("alias", "all_aum", "top_aum", "dominant")


@job("agg_match_quality", "WITH p AS (SELECT doc_id, n_chars>1500 AS yes FROM documents), j AS (SELECT count_if(yes AND quality=1) AS tp, count_if(yes AND quality=0) AS fp, count_if(NOT yes AND quality=1) AS fn FROM labels JOIN p USING (doc_id)) "
     "SELECT tp, fp, fn, round(tp/(tp+fp),3) AS precision, round(tp/(tp+fn),3) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))),3) AS f1 FROM j")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").where("n_chars > 1500").select("doc_id").join(lab.select("doc_id"), "doc_id", "left_semi")
    return firms.quality(docs, lab.where("quality = 1"), ["doc_id"])


@job("agg_firm_index", q("lk", "SELECT CAST(crd AS VARCHAR) AS crd, count(DISTINCT k) AS story_count FROM lk GROUP BY 1"))
def _(spark, sf):
    return rollups.firm_index(shared.story_crds(spark, sf))


@job("agg_archive_weeks", "SELECT CAST(date_trunc('week', d) AS DATE)::VARCHAR AS monday, count(*) AS days FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    return feed.archive_weeks(d, "day").select(F.col("monday").cast("string").alias("monday"), "days")


# ---------------------------------------------------------------- windows
@job("win_headline_pick", q("it", "SELECT k, arg_min(id,o) AS id, arg_min(title,o) AS title FROM it GROUP BY k"))
def _(spark, sf):
    return rollups.headline_pick(shared.items(spark, sf)).select(F.col("component").alias("k"), "id", "title")


@job("win_first_source_link", q("it", "SELECT k, source, id, 'https://outlet_'||o||'.example.com/Deals/'||k||'/?id='||k AS url FROM it"))
def _(spark, sf):
    return rollups.first_links(shared.items(spark, sf)).select(F.col("component").alias("k"), "source", "id", "url")


@job("win_firm_order", q("lk", "SELECT k, CAST(crd AS VARCHAR) AS crd, row_number() OVER (PARTITION BY k ORDER BY p, i, o) AS n FROM (SELECT k, crd, min(published_at) AS p, min(id) AS i, arg_min(ord, id) AS o FROM lk GROUP BY 1,2)"))
def _(spark, sf):
    return rollups.firm_order(shared.links(spark, sf)).select(F.col("component").alias("k"), "crd", "n")


@job("win_last_row_per_key", "SELECT l_orderkey, arg_max(l_suppkey, (l_linenumber, l_suppkey, l_partkey)) AS l_suppkey FROM lineitem GROUP BY 1")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("ord"))
    return adv_src.last_row_per_key(l, "l_orderkey", "ord").select("l_orderkey", "l_suppkey")


@job("win_fan_out", "WITH p AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS key, s_nationkey*10.0 AS x, s_nationkey*5.0 AS y FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY x,y ORDER BY key)-1 AS i FROM p) "
     "SELECT key, round(x+0.55*sqrt(i)*cos(i*pi()*(3-sqrt(5))),4) AS x, round(y+0.55*sqrt(i)*sin(i*pi()*(3-sqrt(5))),4) AS y FROM r")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), (F.col("s_nationkey") * 10.0).cast("double").alias("x"),
                                            (F.col("s_nationkey") * 5.0).cast("double").alias("y"))
    return geo.fan_out(s, "key").select("key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_TOP = f"SELECT cluster_id, headline, row_number() OVER (ORDER BY outlet_count DESC, last_published DESC, cluster_id DESC) AS rank FROM cl WHERE first_seen > {START} AND last_published >= {START} - INTERVAL 2 DAY"


def _top(spark, sf, n=15, make=shared.stories):
    s = make(spark, sf).withColumnRenamed("cluster_id", "id")
    return feed.top_stories(s, feed.window_start(F.lit(frames.PREVIOUS).cast("timestamp"), frames.now()), n)


@job("win_rank_digest", q("cl", f"SELECT cluster_id, rank FROM ({_TOP}) WHERE rank<=15"))
def _(spark, sf):
    return _top(spark, sf).select(F.col("id").alias("cluster_id"), "rank")


@job("win_recent_deals_per_adviser", q("cl", "SELECT CAST(crd AS VARCHAR) AS crd, cluster_id, n FROM (SELECT *, row_number() OVER (PARTITION BY crd ORDER BY first_published DESC, cluster_id DESC) AS n FROM "
                                       "(SELECT acq_crd AS crd, first_published, cluster_id FROM cl UNION ALL SELECT tgt_crd, first_published, cluster_id FROM cl)) WHERE n<=3"))
def _(spark, sf):
    return geo.recent_deals(shared.deals(spark, sf), frames.now()).select("crd", "cluster_id", "n")


@job("win_day_groups", q("cl", f"SELECT cluster_id, CAST({day('last_published')} AS VARCHAR) AS day, row_number() OVER (PARTITION BY {day('last_published')} ORDER BY last_published DESC, cluster_id DESC)=1 AS opens_day FROM cl"))
def _(spark, sf):
    d = feed.day_heads(shared.stories(spark, sf).withColumnRenamed("cluster_id", "id"))
    return d.select(F.col("id").alias("cluster_id"), F.col("day").cast("string").alias("day"), "opens_day")


@job("win_new_since_previous", f"SELECT user_id, event_id, {ts('lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS previous FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", sts(F.lag("ts").over(w)).alias("previous"))


# ---------------------------------------------------------------- ranking
@job("topk_digest", q("cl", f"SELECT cluster_id, headline FROM ({_TOP}) WHERE rank<=25"))
def _(spark, sf):
    return _top(spark, sf, 25, shared.stories_once).select(F.col("id").alias("cluster_id"), "headline")


@job("topk_more_items", q("cl", f"SELECT cluster_id FROM ({_TOP}) WHERE rank BETWEEN 3 AND 12"))
def _(spark, sf):
    done = _top(spark, sf, 2).select("id")
    rest = _top(spark, sf, 25).join(done, "id", "left_anti").orderBy("rank").limit(10)
    return rest.select(F.col("id").alias("cluster_id"))


@job("sort_stories", q("it", "SELECT id, title FROM it ORDER BY published_at DESC, id DESC"))
def _(spark, sf):
    return shared.items(spark, sf).orderBy(F.desc("published_at"), F.desc("id")).select("id", "title")


@job("sort_clusters", q("cl", "SELECT cluster_id FROM cl ORDER BY last_published DESC, cluster_id DESC"))
def _(spark, sf):
    s = shared.stories(spark, sf).withColumnRenamed("cluster_id", "id")
    return feed.newest_first(s).select(F.col("id").alias("cluster_id"))


@job("sort_deals_multi", q("cl", "SELECT cluster_id, acquirer FROM cl ORDER BY lower(acquirer), first_published DESC, cluster_id DESC"))
def _(spark, sf):
    rows = rollups.deal_rows(shared.items_once(spark, sf), frames.WIRES)  # the order by acquirer needs no assets and no linked firms
    return feed.sort_deals(rows, "acq", ascending=True).select("cluster_id", "acquirer")


@job("topk_largest_deals_week", q("cl", f"SELECT cluster_id, value_usd FROM cl WHERE {day('first_published')} >= {TODAY} - 7 AND (value_usd IS NOT NULL OR (seg='wealth management' AND aum_usd IS NOT NULL)) "
                                  "ORDER BY coalesce(value_usd,0) DESC, first_published DESC, cluster_id DESC LIMIT 6"))
def _(spark, sf):
    recent = shared.deals_among(spark, sf, lambda d: feed.trailing_deals(d, frames.now()))
    return feed.largest_deals(recent, frames.now()).select("cluster_id", "value_usd")


@job("topk_adviser_search", q("adv", "SELECT crd FROM adv WHERE lower(name||' '||city) LIKE '%bc%' ORDER BY coalesce(aum_usd,0) DESC, crd LIMIT 8"))
def _(spark, sf):
    v = rollups.firm_view(frames.advisers(spark, sf)).select("crd", "name", "city", F.coalesce("sec_aum_usd", F.lit(0.0)).alias("aum_usd"))
    return geo.search(v, "bc").select("crd")


@job("topk_viewport", "SELECT s_suppkey FROM supplier WHERE s_suppkey%975 BETWEEN 0 AND 600 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 975).cast("double").alias("x"), F.lit(1.0).alias("y"), F.col("s_acctbal").alias("aum_usd"))
    path = jobs.work_folder(spark)
    map_index.write_map(s, path)
    return map_index.box(spark, path, 0, 0, 600, 10).orderBy(F.desc("aum_usd"), "s_suppkey").limit(10).select("s_suppkey")


_PT = "pt AS (SELECT p_partkey, (p_partkey*17%9750)/10.0 AS px, (p_partkey*31%6100)/10.0 AS py FROM part), sp AS (SELECT s_suppkey, (s_suppkey*53%9750)/10.0 AS x, (s_suppkey*29%6100)/10.0 AS y FROM supplier)"


@job("topk_nearest_adviser", f"WITH {_PT} SELECT p_partkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey FROM (SELECT *, sqrt((px-x)*(px-x)+(py-y)*(py-y)) AS d FROM pt JOIN sp ON abs(px-x)<=6 AND abs(py-y)<=6) WHERE d<=6 GROUP BY 1")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    pts = table(spark, sf, "part").select("p_partkey", ((k * 17 % 9750) / 10).alias("px"), ((k * 31 % 6100) / 10).alias("py"))
    f = table(spark, sf, "supplier").select(s.alias("crd"), ((s * 53 % 9750) / 10).alias("x"), ((s * 29 % 6100) / 10).alias("y"))
    return geo.nearest(pts, f, "p_partkey").select("p_partkey", F.col("crd").alias("s_suppkey"))


@job("sort_watch_first", q("cl", f"SELECT cluster_id, row_number() OVER (ORDER BY cluster_id%2=0 DESC, rank) AS n FROM ({_TOP}) WHERE rank<=15"))
def _(spark, sf):
    watched = shared.stories(spark, sf).where("cluster_id % 2 = 0").select(F.col("cluster_id").alias("id"))
    return feed.watch_first(_top(spark, sf), watched).select(F.col("id").alias("cluster_id"), "n")


@job("page_feed", q("cl", "SELECT cluster_id FROM cl ORDER BY last_published DESC, cluster_id DESC LIMIT 50 OFFSET 50"))
def _(spark, sf):
    return feed.page(shared.stories(spark, sf).withColumnRenamed("cluster_id", "id"), 2).select(F.col("id").alias("cluster_id"))


@job("topk_compact_order", q("adv", "SELECT n AS crd, CAST(coalesce(aum_usd,0) AS BIGINT) AS aum FROM pl WHERE mapped ORDER BY aum DESC, n", _ZIP, _Z3, _ON))
def _(spark, sf):
    return shared.map_rows(spark, sf).orderBy(F.desc("aum_usd"), "crd").select("crd", F.col("aum_usd").cast("bigint").alias("aum"))


# ---------------------------------------------------------------- sets and dedupe
@job("dedupe_canonical_url", "SELECT l_linenumber, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    from ..functions.urls import canonical_url

    l = table(spark, sf, "lineitem")
    u = F.format_string("HTTPS://Outlet_%d.example.com:443/deal/%d/?utm_campaign=%d&gclid=x#f", F.col("l_linenumber").cast("int"), F.col("l_orderkey"), F.col("l_suppkey"))
    d = l.select("l_linenumber", canonical_url(u).alias("canonical_url")).dropDuplicates(["canonical_url"])
    return d.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@job("union_multi_feed", "SELECT l_orderkey, min(l_linenumber) AS feed, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY 1")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("feed"), "l_suppkey", F.struct("l_linenumber", "l_suppkey").alias("ord"))
    return feeds.merge_feeds(l, "ord", "l_orderkey").select("l_orderkey", "feed", "l_suppkey")


@job("union_wire_first_titles", q("it", "SELECT k, arg_min(title, o) AS lead_title, arg_max(title, o) AS last_title FROM it GROUP BY k"))
def _(spark, sf):
    order = F.struct(~F.col("source").isin(*frames.WIRES), F.col("published_at"), F.col("id"))
    g = shared.items(spark, sf).groupBy("component").agg(F.min_by("title", order).alias("lead_title"), F.max_by("title", order).alias("last_title"))
    return g.select(F.col("component").alias("k"), "lead_title", "last_title")


@job("except_missing_clusters", "WITH p AS (SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber=1 UNION ALL SELECT -1), r AS (SELECT o_orderkey AS id FROM orders) "
     "SELECT 'missing' AS problem, id FROM r WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT DISTINCT 'unknown', id FROM p WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'duplicate', id FROM p GROUP BY id HAVING count(*)>1")
def _(spark, sf):
    l = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    extra = l.limit(1).select(F.lit(-1).cast("bigint").alias("id"))
    return quality.id_set_problems(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), l.unionByName(extra), "id").select("problem", "id")


@job("purge_non_deals", q("art", "SELECT id FROM art WHERE kind<6"))
def _(spark, sf):
    return rollups.purge(frames.articles(spark, sf), shared.items(spark, sf)).select("id")


@job("intersect_same_deal_set", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber=1 EXCEPT SELECT o_orderkey FROM orders))=0 AND (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber=1))=0 AS same")
def _(spark, sf):
    l = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    return quality.same_sets(l, table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")


