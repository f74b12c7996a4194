"""Queries: text, date and money transformations, deal extraction, tagging, firm linking, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, money, sql, text, urls
from ..operators import amounts, feed, firms, geo, graph, industry, rollups, similarity, stories, wealth
from ..operators import deals as dl
from ..sources import advisers as adv_src
from . import frames, shared
from .frames import table
from .oracle import day, q, ts
from ..session import small_side
from .registry import job, joined
from .registry import ts as sts

# ---------------------------------------------------------------- transformations


@job("norm_urls", "SELECT page_id, lower(regexp_extract(url,'^(https?://[^/?#]+)',1))||rtrim(regexp_extract(url,'^https?://[^/?#]+([^?#]*)',1),'/')||"
     "CASE WHEN regexp_extract(url,'\\?([^#]*)',1) IN ('','utm_source=feed') THEN '' ELSE '?'||regexp_extract(url,'\\?([^#]*)',1) END AS canonical_url FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@job("sql_functions",
     "WITH p AS (SELECT page_id, lower(regexp_extract(url,'^https?://([^/?#]+)',1)) AS host, regexp_extract(html,'<h1>(.*?)</h1>',1,'s') AS h, url FROM pages) SELECT page_id, "
     "regexp_replace(host,'^www\\.','') AS host, lower(regexp_extract(url,'^(https?://[^/?#]+)',1))||rtrim(regexp_extract(url,'^https?://[^/?#]+([^?#]*)',1),'/')||"
     "CASE WHEN regexp_extract(url,'\\?([^#]*)',1) IN ('','utm_source=feed') THEN '' ELSE '?'||regexp_extract(url,'\\?([^#]*)',1) END AS canonical_url, "
     "trim(regexp_replace(lower(h),'[^a-z0-9]+',' ','g')) AS headline, len(list_filter(string_split(trim(regexp_replace(lower(h),'[^a-z0-9]+',' ','g')),' '), lambda w: w<>'')) AS words FROM p")
def _(spark, sf):
    """Pages by SQL text alone: functions for addresses and headlines, and a table function in a lateral join."""
    sql.register(spark)
    pages = table(spark, sf, "pages")
    return spark.sql(
        r"with p as (select page_id, url, regexp_extract(html, r'(?s)<h1>(.*?)</h1>', 1) as h from {pages}) "
        "select page_id, url_bare_host(url) as host, url_canonical(url) as canonical_url, headline_norm(h) as headline, "
        "(select count(*) from headline_words(h)) as words from p", pages=pages)


@job("clean_urls", "SELECT page_id, regexp_replace(regexp_replace(url,'#.*$',''),'\\?utm_source=feed$','') AS link FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.clean_link(F.col("url")).alias("link"))


_ENT = "html"
for _tag in ("<script.*?</script>", "<style.*?</style>", "<!--.*?-->", "<[a-zA-Z/!?][^>]*>"):
    _ENT = f"regexp_replace({_ENT},'{_tag}',' ','gs')"
for _name, _char in text.ENTITIES.items():
    _ENT = f"replace({_ENT},'&{_name};','{ {'apos': chr(39) * 2, 'nbsp': ' '}.get(_name, _char) }')"


@job("clean_text", f"SELECT page_id, trim(regexp_replace({_ENT},'\\s+',' ','g')) AS body FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


_CUT = "substr(trim(text),1,299)"
_SP = f"(299 - strpos(reverse({_CUT}),' '))"


@job("truncate_words", f"SELECT doc_id, CASE WHEN length(trim(text))<=300 THEN trim(text) ELSE rtrim(CASE WHEN strpos({_CUT},' ')>0 AND {_SP}>180 THEN substr({_CUT},1,{_SP}) ELSE {_CUT} END,' ,;:.-–—')||'…' END AS teaser FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_words(F.col("text")).alias("teaser"))


@job("strip_source_suffix", q("art", "SELECT id, title FROM art"))
def _(spark, sf):
    a = frames.articles(spark, sf)
    tail = F.when(F.col("deal_key") % 2 == 0, F.concat(F.lit(" | "), F.col("source"))).otherwise(F.concat(F.lit(" – "), F.upper("source"), F.lit(".com")))
    return a.select("id", text.strip_source_suffix(F.concat("title", tail), F.col("source")).alias("title"))


@job("parse_dates", f"SELECT o_orderkey, {ts('''CASE o_orderkey%4 WHEN 0 THEN o_orderdate + INTERVAL 5 HOUR WHEN 1 THEN o_orderdate + INTERVAL 30 MINUTE ELSE timezone('UTC', timezone('America/Los_Angeles', o_orderdate)) END''')} AS at FROM orders")
def _(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    v = (F.when(k == 0, F.concat(F.lit("Mon, "), F.date_format(d, "dd MMM yyyy HH:mm:ss"), F.lit(" EST")))
         .when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-00:30")))
         .when(k == 2, F.concat(F.lit("Published on "), F.date_format(d, "MMMM d, yyyy"))).otherwise(F.date_format(d, "M/d/yyyy")))
    return table(spark, sf, "orders").select("o_orderkey", sts(dates.parse_date(v)).alias("at"))


@job("fix_published", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_shipdate > TIMESTAMP '2000-01-02' THEN '2000-01-01 00:00:00' ELSE {ts('l_shipdate')} END AS at, l_shipdate > TIMESTAMP '2000-01-02' AS estimated FROM lineitem")
def _(spark, sf):
    w = dates.published_or_fetched(F.col("l_shipdate").cast("timestamp"), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "lineitem").withColumn("w", w).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", sts("w.at").alias("at"), "w.estimated")


@job("local_day", f"SELECT event_id, CAST({day('ts')} AS VARCHAR) AS day, CAST(CAST(date_trunc('week',{day('ts')}) AS DATE) AS VARCHAR) AS monday, strftime({day('ts')},'%G-W%V') AS week FROM events")
def _(spark, sf):
    d = dates.local_day(F.col("ts"))
    return table(spark, sf, "events").withColumn("d", d).select("event_id", F.col("d").cast("string").alias("day"), dates.monday_of(F.col("d")).cast("string").alias("monday"), dates.iso_week(F.col("d")).alias("week"))


@job("money_mentions", q("art", "SELECT id, strpos(title,'$')-1 AS start, strpos(title,'$')-1+length(p) AS \"end\", price AS value FROM art WHERE strpos(title,'$')>0"))
def _(spark, sf):
    return shared.mention_rows(spark, sf)


@job("norm_headline", q("it", "SELECT id, CASE kind WHEN 1 THEN lower(a)||' complete acquire '||lower(b) WHEN 2 THEN lower(b)||' agree acquire '||lower(a) WHEN 3 THEN lower(a)||' talk acquire '||lower(b) "
                        "WHEN 5 THEN lower(a)||' '||lower(b)||' merge' WHEN 0 THEN lower(a)||' acquire '||seg||' '||lower(b)||' usd'||lower(substr(p,2)) "
                        "ELSE CASE WHEN seg='wealth management' THEN lower(a)||' acquire usd'||lower(substr(p,2))||' '||lower(b) ELSE lower(a)||' take minority stake '||lower(b) END END AS tokens FROM it"))
def _(spark, sf):
    return shared.items_once(spark, sf).select("id", joined(similarity.headline_tokens(F.col("title")), " ").alias("tokens"))


@job("norm_adviser_numbers", "SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN NULL ELSE abs(round(c_acctbal*100))/100 END AS amount, CAST(CASE WHEN c_custkey%2=0 THEN c_custkey%500+100 ELSE c_custkey%90 END AS BIGINT) AS clients, c_nationkey+1 AS offices FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    raw = F.when(k % 3 == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit("$ "), F.format_number(F.abs("c_acctbal"), 2)))
    over = F.when(k % 2 == 0, (k % 500 + 100).cast("string")).otherwise(F.lit("0"))
    clients = F.coalesce(F.nullif(adv_src.number(over), F.lit(0.0)), adv_src.number((k % 90).cast("string")))
    return c.select("c_custkey", adv_src.number(raw).alias("amount"), clients.cast("bigint").alias("clients"), (adv_src.number(F.col("c_nationkey").cast("string")).cast("bigint") + 1).alias("offices"))


@job("adviser_location", "SELECT CAST(c_custkey AS VARCHAR) AS crd, CASE WHEN c_custkey%2=0 THEN lpad(CAST(c_custkey%100000 AS VARCHAR),5,'0') ELSE '98101' END AS zip, CASE WHEN c_custkey%2=0 THEN 'OR' ELSE 'WA' END AS state, c_custkey%2=1 AS approx FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    even = k % 2 == 0
    raw = table(spark, sf, "customer").select(
        k.cast("string").alias("c0"), F.lit("801-1").alias("c1"), F.col("c_name").alias("c2"), F.when(even, "or").otherwise("").alias("c3"),
        F.when(even, F.concat(F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("-0001"))).otherwise("").alias("c4"),
        F.lit("wa").alias("c5"), F.lit("98101-2222").alias("c6"))
    heads = {"c0": "Organization CRD#", "c1": "SEC#", "c2": "Legal Name", "c3": "Main Office State", "c4": "Main Office Postal Code",
             "c5": "Location of Books and Records State", "c6": "Location of Books and Records Postal Code"}
    return adv_src.advisers_from_table(raw, heads, frames.SEC_DATE).select("crd", "zip", "state", F.col("profile.approx_location").alias("approx"))


@job("adviser_ratios", q("adv", "SELECT crd, CASE WHEN aum_usd>0 AND accounts>0 THEN CAST(round_even(aum_usd/accounts,0) AS BIGINT) END AS avg_account_usd, CASE WHEN aum_usd>0 AND disc>0 THEN CAST(round_even(100*disc/aum_usd,0) AS BIGINT) END AS discretionary_pct FROM adv"))
def _(spark, sf):
    d = geo.details(frames.advisers(spark, sf), rollups.firm_index(shared.story_firms(spark, sf)), geo.recent_deals(shared.deals(spark, sf), frames.now()))
    return d.select("crd", "avg_account_usd", "discretionary_pct")


@job("money_labels", "SELECT o_orderkey, CASE WHEN v>=1e12 THEN '$'||rtrim(rtrim(printf('%.2f', v/1e12),'0'),'.')||'T' WHEN v>=1e9 THEN '$'||rtrim(rtrim(printf('%.2f', v/1e9),'0'),'.')||'B' ELSE '$'||CAST(v/1e6 AS BIGINT)||'M' END AS label "
     "FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey%3=0 THEN o_orderkey*1e6 WHEN o_orderkey%3=1 THEN (o_orderkey+1)*1e8 ELSE (o_orderkey%100+1)*1e11 END AS DOUBLE) AS v FROM orders) WHERE v>0")
def _(spark, sf):
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 0, k * F.lit(1e6)).when(k % 3 == 1, (k + 1) * F.lit(1e8)).otherwise((k % 100 + 1) * F.lit(1e11))
    return table(spark, sf, "orders").select("o_orderkey", money.money_label(v).alias("label")).where("label is not null")


@job("codes_to_labels", q("adv", "SELECT crd, rtrim(concat_ws('',CASE WHEN (n*2+1)%3=0 THEN 'Percentage of AUM|' END, CASE WHEN (n*2+2)%3=0 THEN 'Hourly charges|' END, CASE WHEN (n*2+3)%3=0 THEN 'Subscription fees|' END, "
                          "CASE WHEN (n*2+4)%3=0 THEN 'Fixed fees|' END, CASE WHEN (n*2+5)%3=0 THEN 'Commissions|' END, CASE WHEN (n*2+6)%3=0 THEN 'Performance-based fees|' END, CASE WHEN (n*2+7)%3=0 THEN 'Other|' END),'|') AS fees FROM adv"))
def _(spark, sf):
    return frames.advisers(spark, sf).select("crd", joined(geo.labels_of(F.col("profile.compensation"), geo.COMPENSATION)).alias("fees"))


@job("pack_flags", q("adv", "SELECT crd, CASE WHEN n%10=3 THEN 4 ELSE 0 END + CASE WHEN n%6=0 THEN 8 ELSE 0 END AS flags, " + "+".join(f"CASE WHEN (n+{i})%3=0 THEN {1 << (i - 1)} ELSE 0 END" for i in range(1, 13)) + " AS services FROM adv"))
def _(spark, sf):
    p = F.col("profile")
    return frames.advisers(spark, sf).select("crd", geo.flags(F.lit(False), F.lit(False), p["disclosures"], p["wrap"]).alias("flags"), geo.bit_mask(p["services"]).alias("services"))


@job("website_urls", q("adv", "SELECT crd, CASE n%4 WHEN 0 THEN 'https://www.'||lower(base)||'.com' WHEN 1 THEN 'http://'||lower(base)||'.com' END AS website FROM adv"))
def _(spark, sf):
    return frames.advisers(spark, sf).select("crd", geo.website(F.col("profile.website")).alias("website"))


@job("highlight_terms", q("it", "SELECT id, regexp_replace(title, '(buy|merge)', '<mark>\\1</mark>', 'g') AS title FROM it"))
def _(spark, sf):
    return shared.items(spark, sf).select("id", feed.highlight(F.col("title"), "buy merge").alias("title"))


# ---------------------------------------------------------------- deal extraction
@job("deal_classify", q("it", "SELECT id, acquirer, target, deal_type, stage, value_usd FROM it"))
def _(spark, sf):
    return dl.parse_deals(frames.articles(spark, sf)).select("id", "deal.acquirer", "deal.target", "deal.deal_type", "deal.stage", "deal.value_usd")


@job("deal_party_names", q("art", "SELECT id, a AS subject, b AS object FROM art"))
def _(spark, sf):
    a = frames.articles(spark, sf)
    phrases = {"subject": F.concat(F.lit("Seattle-based wealth manager "), F.col("a"), F.lit(" in a big week")),
               "object": F.concat(F.lit("$2.5B Louisiana RIA "), F.col("b"), F.lit(" for cash"))}
    return dl.party_names(a.select("id", "a", "b"), phrases).select("id", "subject", "object")


@job("deal_stage", q("art", "SELECT id, CASE kind WHEN 1 THEN 'completed' WHEN 3 THEN 'rumored' ELSE 'announced' END AS stage FROM art"))
def _(spark, sf):
    return frames.articles(spark, sf).select("id", dl.stage(F.col("title")).alias("stage"))


@job("deal_value", q("art", "SELECT id, CASE WHEN kind=0 THEN price END AS value_usd FROM art"))
def _(spark, sf):
    return frames.articles(spark, sf).select("id", dl.stated_price(F.col("title")).alias("value_usd"))


@job("deal_parse_wealth", q("it", "SELECT id, a AS acquirer, CASE WHEN kind<>0 THEN b ELSE '' END AS target, CASE WHEN kind=4 THEN price END AS target_aum_usd, CASE WHEN kind<>0 THEN 'high' ELSE 'low' END AS confidence FROM it WHERE seg='wealth management'"))
def _(spark, sf):
    w = wealth.parse_wealth(shared.items(spark, sf).where("seg = 'wealth management'"))
    return w.select("id", "wealth.acquirer", "wealth.target", "wealth.target_aum_usd", "wealth.confidence")


@job("deal_rows", q("cl", f"SELECT cluster_id, acquirer, target, deal_type, stage, value_usd, 'high' AS confidence, '' AS note, press_release, {ts('first_published')} AS deal_date FROM cl"))
def _(spark, sf):
    d = rollups.deal_rows(shared.items(spark, sf), frames.WIRES)
    return d.select("cluster_id", "acquirer", "target", "deal_type", "stage", "value_usd", "confidence", "note", "press_release", sts("deal_date").alias("deal_date"))


@job("deal_target_aum_source", q("cl adv", "SELECT cluster_id, CASE WHEN cl.aum_usd IS NOT NULL THEN cl.aum_usd WHEN adv.aum_usd>0 THEN adv.aum_usd END AS target_aum_usd, CASE WHEN cl.aum_usd IS NOT NULL THEN 'headline' WHEN adv.aum_usd>0 THEN 'sec' END AS target_aum_source FROM cl JOIN adv ON adv.n=tgt_crd"))
def _(spark, sf):
    return shared.deals(spark, sf).select("cluster_id", "target_aum_usd", "target_aum_source")


@job("aum_mentions", q("art", "SELECT id, price AS aum_usd FROM art WHERE kind=4 AND seg='wealth management'"))
def _(spark, sf):
    return frames.articles(spark, sf).select("id", amounts.aum_mention(F.col("title")).alias("aum_usd")).where("aum_usd is not null")


@job("aum_item_rule", q("it", "SELECT id, aum_usd FROM it"))
def _(spark, sf):
    return rollups.item_aum(shared.items(spark, sf)).select("id", "aum_usd")


@job("deal_keep_rate_audit", q("art", "SELECT source, count(*) AS seen, count_if(kind<6) AS kept, round(count_if(kind<6)/count(*),4) AS rate FROM art GROUP BY 1"))
def _(spark, sf):
    return dl.is_deal_counts(frames.articles(spark, sf)).select("source", "seen", "kept", F.round(F.col("kept") / F.col("seen"), 4).alias("rate"))


# ---------------------------------------------------------------- industries
@job("tag_industries", q("it", "SELECT id, industry AS industries FROM it"))
def _(spark, sf):
    return dl.tagged_deals(frames.articles(spark, sf)).select("id", joined("industries").alias("industries"))


@job("tag_primary", q("it", "SELECT id, CASE WHEN source='outlet_3' AND industry NOT LIKE 'Wealth%' THEN 'Energy & Utilities' ELSE industry END AS category FROM it"))
def _(spark, sf):
    hints = frames.source_config(spark, sf).select(F.col("name").alias("source"), F.col("industry").alias("hint"))
    a = frames.articles(spark, sf).join(small_side(hints), "source", "left")
    return dl.tagged_deals(a, hint="hint").select("id", "category")


@job("tag_counts", q("it", "SELECT industry, count(*) AS n FROM it GROUP BY 1"))
def _(spark, sf):
    return industry.counts(shared.items_once(spark, sf))


# ---------------------------------------------------------------- firm linking
@job("firm_alias_table", q("adv", "SELECT lower(base) AS alias, crd, false AS is_full FROM adv UNION ALL SELECT lower(base)||' capital', crd, false FROM adv UNION ALL SELECT lower(base)||' capital partners', crd, true FROM adv"))
def _(spark, sf):
    a = firms.alias_rows(frames.advisers(spark, sf))
    return a.groupBy("alias", "crd").agg(F.max("is_full").alias("is_full"))


@job("firm_tokens", q("art", "SELECT id, len(string_split(title,' ')) AS tokens, lower(string_split(title,' ')[1]) AS first FROM art"))
def _(spark, sf):
    t = firms.token_rows(frames.articles(spark, sf), "id", "title")
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("tokens"), F.min_by("token", "pos").alias("first"))


_FM = ("SELECT id, CAST(o_custkey*2 AS VARCHAR) AS crd, CASE kind WHEN 2 THEN 6 ELSE 0 END AS start_token FROM it UNION ALL SELECT id, CAST(suppkey*2+1 AS VARCHAR), "
       "CASE kind WHEN 0 THEN len(string_split(seg,' '))+4 WHEN 1 THEN 4 WHEN 2 THEN 0 WHEN 3 THEN 5 WHEN 4 THEN CASE WHEN seg='wealth management' THEN 4 ELSE 5 END ELSE 2 END FROM it")


@job("firm_match", q("it", _FM))
def _(spark, sf):
    return shared.matches(spark, sf).select("id", "crd", "start_token")


@job("firm_longest_match", q("adv", "SELECT crd AS id, lower(base)||' capital partners' AS alias, 1 AS start_token, 4 AS end_token FROM adv"))
def _(spark, sf):
    t = frames.advisers(spark, sf).select(F.col("crd").alias("id"), F.concat(F.lit("Today "), F.col("business_name"), F.lit(" grows again")).alias("title"))
    return firms.match(t, "id", "title", shared.dictionary(spark, sf)).select("id", "alias", "start_token", "end_token")


@job("firm_fallback_spans", q("art", "SELECT id, a||' Wealth Advisors' AS name FROM art UNION ALL SELECT id, b||' Family Office' FROM art"))
def _(spark, sf):
    t = frames.articles(spark, sf).select("id", F.concat(F.col("a"), F.lit(" Wealth Advisors buys $1B RIA "), F.col("b"), F.lit(" Family Office, as Private Wealth grows")).alias("t"))
    return firms.span_names(t, "id", "t").select("id", "name")


@job("firm_item_links", q("lk", "SELECT id, CAST(crd AS VARCHAR) AS crd, true AS in_title FROM lk"))
def _(spark, sf):
    return shared.item_links(spark, sf).select("id", "crd", "in_title")


@job("firm_subject", q("it", "SELECT id, CAST(subject AS VARCHAR) AS subject_crd FROM it"))
def _(spark, sf):
    return firms.subjects(shared.slim_items(spark, sf), "id", "title", shared.matches(spark, sf))


@job("firm_watch_hits", q("it adv", "SELECT DISTINCT k, base AS name FROM it JOIN adv ON nation=0 AND n IN (o_custkey*2, suppkey*2+1)"))
def _(spark, sf):
    w = frames.advisers(spark, sf).where("city = 'CITY 0'").select(F.split("business_name", " ")[0].alias("name"), F.array().cast("array<string>").alias("aliases"))
    it = shared.items(spark, sf)
    h = firms.watch_hits(it, "id", "title", firms.watch_terms(w))
    return h.join(it.select("id", "component"), "id").select(F.col("component").alias("k"), "name").distinct()


@job("firm_watch_terms", q("adv", "SELECT base AS name, base AS term FROM adv UNION ALL SELECT base, name FROM adv"))
def _(spark, sf):
    base = F.split("business_name", " ")[0]
    w = frames.advisers(spark, sf).select(base.alias("name"), F.array(F.upper(base), F.lit("GS"), F.regexp_replace("business_name", " ", "   ")).alias("aliases"))
    return firms.watch_terms(w)


# ---------------------------------------------------------------- similarity and graph
def _keyed(spark, sf):
    return shared.items(spark, sf).join(stories.title_firms(shared.links(spark, sf)), "id", "left")


# Numbers as words of consonants, a different one for every number: hashes of so few letters meet by chance in large tables.
_SIXTEEN, _THIRTY_TWO = "bcdfghjklmnpqrtv", "bcdfghjklmnpqrtvwxzαβγδεζηθκλμνξ"


def _word(k, i):
    """Word i (0 to 8) of order k, six letters."""
    return F.translate(F.lpad(F.conv(k * 9 + i, 10, 32), 6, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _THIRTY_TWO)


def _brand(number):
    return F.initcap(F.translate(F.lpad(F.hex(number), 10, "0"), "0123456789ABCDEF", _SIXTEEN))


# Two headlines per order: the second holds the first's five made-up words and up to two more, so its edit distances are
# differences in length; every eleventh shares one word only. Times differ by whole days, and every thirteenth pair has one source.
def _extended(spark, sf):
    k = F.col("o_orderkey")
    word = lambda i: _word(k, i)
    own = F.array(*[word(i) for i in range(5)])
    longer = F.when(k % 11 == 0, F.array(word(0), *[word(i) for i in range(5, 9)])).when(k % 3 == 0, F.concat(own, F.array(word(5)))).otherwise(
        F.concat(own, F.array(word(5), word(6))))
    # headlines are far heavier than the keys they are made from, so the keys are spread first
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").repartition("o_orderkey").select(
        k.alias("k"), F.to_timestamp("o_orderdate").alias("at"), own.alias("own"), longer.alias("longer"))
    side = lambda i, title, at, source: o.select(
        (F.col("k") * 2 + i).alias("id"), F.lit(source).alias("source") if isinstance(source, str) else source.alias("source"), at.alias("published_at"),
        F.array_join(title, " ").alias("title"), F.array().cast("array<string>").alias("firms"))
    later = F.col("at") + F.make_dt_interval((F.col("k") % 5).cast("int"))
    return side(0, "own", F.col("at"), "a").union(side(1, "longer", later, F.when(F.col("k") % 13 == 0, "a").otherwise("b")))


_LINKED = "o_orderkey%5<=3 AND o_orderkey%11<>0"


@job("sim_pair_score", "WITH p AS (SELECT o_orderkey AS k, 34 AS la, 34+7*CASE WHEN o_orderkey%3=0 THEN 1 ELSE 2 END AS lb FROM orders WHERE o_orderkey%11<>0) "
     "SELECT k*2 AS a, k*2+1 AS b, round(least(100, 60+40*(1-(lb-la)/(la+lb))+8), 6) AS score FROM p")
def _(spark, sf):
    # one time for both headlines of a pair, so that every pair is a candidate
    items = _extended(spark, sf).withColumn("published_at", F.lit("2026-09-20").cast("timestamp"))
    s = similarity.signatures(items)
    ids = s.groupBy("sig").agg(F.min("id").alias("id"))
    p = similarity.scored(similarity.candidate_pairs(s)).select("sig_a", "sig_b", "score")
    p = p.join(ids.select(F.col("sig").alias("sig_a"), F.col("id").alias("x")), "sig_a").join(ids.select(F.col("sig").alias("sig_b"), F.col("id").alias("y")), "sig_b")
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("score", 6).alias("score"))


@job("join_fuzzy_window_self", f"SELECT o_orderkey*2 AS src, o_orderkey*2+1 AS dst FROM orders WHERE {_LINKED} AND o_orderkey%13<>0")
def _(spark, sf):
    e = similarity.story_edges(_extended(spark, sf))
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


# Deals of eight orders share a target, of sixteen an acquirer; some name no target or no acquirer.
def _same_deal(spark, sf):
    k = F.col("o_orderkey")
    target = F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(_brand(F.floor(k / 8)), F.lit(" Holdings")))
    acquirer = F.when(k % 5 == 0, F.lit("")).otherwise(_brand(F.floor(k / 16) + 1000000))
    return table(spark, sf, "orders").select(
        k.alias("id"), k.alias("component"), (F.to_timestamp(F.lit("2026-09-01")) + F.make_dt_interval((k % 13).cast("int"))).alias("published_at"),
        F.concat(F.lit("Deal for $"), ((k % 3 + 1) * 10).cast("string"), F.lit("M")).alias("title"), F.struct(acquirer.alias("acquirer"), target.alias("target")).alias("deal"))


_THETA = ("d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey%6<>0 THEN o_orderkey//8 END AS t, CASE WHEN o_orderkey%5<>0 THEN o_orderkey//16 END AS q, o_orderkey%3 AS f, o_orderkey%13 AS at FROM orders), "
          "e AS (SELECT x.k AS src, y.k AS dst FROM d x JOIN d y ON x.t=y.t AND x.k<y.k AND abs(x.at-y.at)<=7 AND (x.q=y.q OR x.q IS NULL OR y.q IS NULL) "
          "UNION SELECT x.k, y.k FROM d x JOIN d y ON x.q=y.q AND x.f=y.f AND x.k<y.k AND abs(x.at-y.at)<=7 AND (x.t IS NULL OR y.t IS NULL))")


@job("join_same_deal_theta", f"WITH {_THETA} SELECT src, dst FROM e")
def _(spark, sf):
    return similarity.same_deal_edges(_same_deal(spark, sf))


@job("sim_block_pairs", "WITH b AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))) AS t FROM lineitem GROUP BY 1) "
     "SELECT least(x.id,y.id) AS a, greatest(x.id,y.id) AS b FROM b x JOIN b y ON x.id<y.id AND x.id//2000=y.id//2000 AND x.t<>y.t AND len(list_intersect(x.t,y.t))>=2")
def _(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("s"), F.col("l_partkey").cast("string")))).alias("toks"))
    empty = F.array().cast("array<string>")
    # one slot per key range; the shared-slot rule of the blocking step also pairs neighbours, which are cut here
    s = l.select(F.concat_ws(":", (F.floor(F.col("l_orderkey") / 2000)).cast("string"), F.col("l_orderkey").cast("string")).alias("sig"), (F.floor(F.col("l_orderkey") / 2000) * 2).alias("slot"),
                 "toks", empty.alias("firms"), F.array().cast("array<double>").alias("money"))
    p = similarity.candidate_pairs(s)
    a, b = F.split("sig_a", ":")[1].cast("bigint"), F.split("sig_b", ":")[1].cast("bigint")
    return p.where(F.col("ta") != F.col("tb")).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


@job("sim_token_jaccard", "WITH b AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey)) AS t, list_distinct(list(l_partkey%50)) AS u FROM lineitem GROUP BY 1) SELECT id, round(len(list_intersect(t,u))/len(list_distinct(list_concat(t,u))),6) AS jaccard FROM b")
def _(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("t"), F.collect_set(F.col("l_partkey") % 50).alias("u"))
    return l.select(F.col("l_orderkey").alias("id"), F.round(similarity.token_jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


_CC = ("WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_custkey - c_custkey%7 AS b FROM customer WHERE c_custkey%7<>0 UNION SELECT DISTINCT c_custkey, c_custkey-7 FROM customer WHERE c_custkey%7=0 AND c_custkey%49<>0), "
       "u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS label FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a=r.id) SELECT id, min(label) AS component FROM r GROUP BY 1")


@job("cc_story", _CC)
def _(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    e = c.where(k % 7 != 0).select(k.alias("src"), (k - k % 7).alias("dst")).union(c.where((k % 7 == 0) & (k % 49 != 0)).select(k, k - 7))
    return graph.components(e)


@job("cc_same_deal", f"WITH RECURSIVE {_THETA}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT k AS id, k AS label FROM d UNION SELECT u.b, r.label FROM r JOIN u ON u.a=r.id) "
     "SELECT id, min(label) AS component FROM r GROUP BY 1")
def _(spark, sf):
    it = _same_deal(spark, sf)
    return graph.merge_components(it, similarity.same_deal_links(it)).select("id", "component")


@job("cluster_stories", f"SELECT o_orderkey*2 AS id, o_orderkey*2 AS cluster_id FROM orders UNION ALL SELECT o_orderkey*2+1, CASE WHEN {_LINKED} AND o_orderkey%13<>0 THEN o_orderkey*2 ELSE o_orderkey*2+1 END FROM orders")
def _(spark, sf):
    items = _extended(spark, sf).drop("firms").withColumn("deal", F.struct(F.lit("").alias("acquirer"), F.lit("").alias("target")))
    links = items.limit(0).select("id", F.lit(True).alias("in_title"), F.lit("").alias("crd"), F.lit("").alias("name"))
    return stories.cluster_stories(items, links).select("id", "cluster_id")


@job("cluster_stories_flow")
def _(spark, sf):
    """The whole flow on headlines of deals, with linked firms and same-deal merging."""
    s = stories.cluster_stories(shared.items(spark, sf).drop("component"), shared.links(spark, sf))
    return s.select("id", "cluster_id")


@job("cluster_threshold_sweep", "WITH p AS (SELECT o_orderkey, o_orderkey%101 AS score, o_orderkey%3=0 AS same, t AS threshold FROM orders, (VALUES (60),(70),(80)) v(t)) SELECT CAST(threshold AS DOUBLE) AS threshold, count_if(score>=threshold AND same) AS tp, "
     "count_if(score>=threshold AND NOT same) AS fp, count_if(score<threshold AND same) AS fn, round(count_if(score>=threshold AND same)/count_if(score>=threshold),3) AS precision, round(count_if(score>=threshold AND same)/count_if(same),3) AS recall FROM p GROUP BY 1")
def _(spark, sf):
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select((k % 101).cast("double").alias("score"), (k % 3 == 0).alias("same"))
    return similarity.threshold_sweep(p, [60, 70, 80])
