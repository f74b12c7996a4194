"""Shared pieces of the check SQL (DuckDB): the derived frames stated from the keys."""

from __future__ import annotations

from .frames import NOW, PREVIOUS, STATES

TS = "'%Y-%m-%d %H:%M:%S'"


def ts(col: str) -> str:
    return f"strftime({col}, {TS})"


def day(col: str) -> str:
    """Local calendar day of a UTC timestamp."""
    return f"CAST(timezone('America/Los_Angeles', timezone('UTC', {col})) AS DATE)"


NOW_TS = f"TIMESTAMP '{NOW}'"
PREV_TS = f"TIMESTAMP '{PREVIOUS}'"
START = f"least({PREV_TS}, {NOW_TS} - INTERVAL 1 DAY)"
TODAY = day(NOW_TS)
MONDAY = f"CAST(date_trunc('week', {TODAY}) AS DATE)"


def _brand(name: str) -> str:
    t = f"translate(substr(md5({name}),1,10),'0123456789abcdef','bcdfghjklmnpqrtv')"
    return f"upper(substr({t},1,1))||substr({t},2)"


_SEG = ("CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'wealth management' WHEN 'AUTOMOBILE' THEN 'automotive' WHEN 'MACHINERY' "
        "THEN 'machinery' WHEN 'FURNITURE' THEN 'furniture' WHEN 'BUILDING' THEN 'real estate' ELSE '' END")
_ART = f"""
src AS (SELECT o_orderkey AS k, o_custkey, suppkey, {_brand('c_name')} AS a, {_brand('s_name')} AS b, {_SEG} AS seg,
   o_orderdate AS d, CAST(floor(o_totalprice/1000)+1 AS BIGINT) AS amt, o_orderkey%5=0 AS isb
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey
  JOIN customer ON c_custkey=o_custkey JOIN supplier ON s_suppkey=suppkey),
art0 AS (SELECT s.*, o, (k+o)%8 AS kind, '$'||amt||CASE WHEN isb THEN 'B' ELSE 'M' END AS p,
   CAST(amt*CASE WHEN isb THEN 1e9 ELSE 1e6 END AS DOUBLE) AS price, d + to_hours(o*5) AS published_at
  FROM src s JOIN (SELECT DISTINCT l_orderkey, l_linenumber AS o FROM lineitem) ON l_orderkey=k),
art AS (SELECT *, k*10+o AS id, 'outlet_'||o AS source, published_at + to_hours(CAST(1+k%5 AS INT)) AS fetched_at,
   'The '||seg||' deal was reported by outlet '||o AS description,
   'https://outlet_'||o||'.example.com/Deals/'||k||'/?utm_source=feed&id='||k||'#top' AS url,
   CASE kind WHEN 0 THEN a||' to acquire '||seg||' firm '||b||' for '||p WHEN 1 THEN a||' completes acquisition of '||b
     WHEN 2 THEN b||' agrees to be acquired by '||a WHEN 3 THEN a||' in talks to buy '||b
     WHEN 4 THEN CASE WHEN seg='wealth management' THEN a||' buys '||p||' RIA '||b ELSE a||' takes minority stake in '||b END
     WHEN 5 THEN a||' and '||b||' to merge' WHEN 6 THEN 'Why '||a||' deals keep getting bigger'
     ELSE a||' Raises Stake in '||b END AS title FROM art0)"""
_IT = """
it AS (SELECT *, a AS acquirer, b AS target,
   CASE kind WHEN 5 THEN 'merger' WHEN 4 THEN CASE WHEN seg='wealth management' THEN 'acquisition' ELSE 'stake' END
     ELSE 'acquisition' END AS deal_type,
   CASE kind WHEN 1 THEN 'completed' WHEN 3 THEN 'rumored' ELSE 'announced' END AS stage,
   CASE kind WHEN 1 THEN 3 WHEN 3 THEN 0 ELSE 2 END AS srank,
   CASE WHEN kind=0 THEN price END AS value_usd,
   CASE WHEN kind=4 AND seg='wealth management' THEN price END AS aum_usd,
   CASE WHEN kind=2 THEN suppkey*2+1 ELSE o_custkey*2 END AS subject,
   CASE seg WHEN 'wealth management' THEN 'Wealth Management & RIAs' WHEN 'furniture' THEN 'Consumer & Retail'
     WHEN 'real estate' THEN 'Real Estate' ELSE 'Industrials' END AS industry,
   min(id) OVER (PARTITION BY k) AS cluster_id FROM art WHERE kind<6)"""
_CL = """
cl AS (SELECT k, min(id) AS cluster_id, arg_min(title, o) AS headline, arg_min(url, o) AS url, min(fetched_at) AS first_seen,
   min(published_at) AS first_published, max(published_at) AS last_published, count(DISTINCT source) AS outlet_count,
   count(*) AS item_count, min(industry) AS industry, min(seg) AS seg, min(a) AS acquirer, min(b) AS target,
   min(o_custkey)*2 AS acq_crd, min(suppkey)*2+1 AS tgt_crd, arg_min(deal_type, o) AS deal_type,
   CASE max(srank) WHEN 3 THEN 'completed' WHEN 2 THEN 'announced' ELSE 'rumored' END AS stage,
   max(value_usd) AS value_usd, max(aum_usd) AS aum_usd, bool_or(o=1) AS press_release,
   count(DISTINCT subject) AS subjects, min(subject) AS subject FROM it GROUP BY k)"""
_LN = """
lk AS (SELECT id, k, source, published_at, o_custkey*2 AS crd, a||' Capital Partners' AS name, CASE WHEN kind=2 THEN 1 ELSE 0 END AS ord FROM it
  UNION ALL SELECT id, k, source, published_at, suppkey*2+1, b||' Capital Partners', CASE WHEN kind=2 THEN 0 ELSE 1 END FROM it)"""
_STATES = "[" + ",".join(f"'{s}'" for s in STATES) + "]"
_ADV = f"""
adv0 AS (SELECT c_custkey*2 AS n, {_brand('c_name')} AS base, c_nationkey AS nation, c_acctbal AS bal FROM customer
  UNION ALL SELECT s_suppkey*2+1, {_brand('s_name')}, s_nationkey, s_acctbal FROM supplier),
adv AS (SELECT n, nation, CAST(n AS VARCHAR) AS crd, base, base||' Capital Partners' AS name, upper(base)||' CAPITAL PARTNERS, LLC' AS legal,
   'City '||nation AS city, {_STATES}[nation%25+1] AS state, CASE WHEN bal>0 THEN floor(bal)*1e6 END AS aum_usd,
   CASE WHEN n%17<>0 THEN lpad(CAST((n*37)%100000 AS VARCHAR),5,'0') END AS zip, n%23=0 AS abroad,
   CAST((n*7)%11*1e6 AS DOUBLE) AS ma, CAST((n*3)%5*1e6 AS DOUBLE) AS mb, CAST((n*5)%13*1e6 AS DOUBLE) AS mf,
   CAST((n*11)%7*1e6 AS DOUBLE) AS mg, CAST((n*13)%3*1e6 AS DOUBLE) AS mm, n%400 AS accounts, floor(bal)*5e5 AS disc,
   n%9=0 AS approx FROM adv0)"""
_ZIP = """
zp AS (SELECT lpad(CAST((p_partkey*74)%100000 AS VARCHAR),5,'0') AS zip, min(30.0+(p_partkey*7919%1500)/100.0) AS lat,
  min(-120.0+(p_partkey*104729%4000)/100.0) AS lon FROM part GROUP BY 1)"""
_PARTS = {"art": [_ART], "it": [_ART, _IT], "cl": [_ART, _IT, _CL], "lk": [_ART, _IT, _CL, _LN], "adv": [_ADV], "zip": [_ZIP]}


def q(needs: str, select: str, *more: str) -> str:
    """WITH the named frames (space separated), further CTEs, then the select."""
    seen: list[str] = []
    for n in needs.split():
        seen += [p for p in _PARTS[n] if p not in seen]
    return "WITH " + ",".join([*seen, *more]) + " " + select
