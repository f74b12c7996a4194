"""Frames derived from the driver tables: articles about deals, advisers and ZIP points.

One order is one deal: its customer buys the supplier with the lowest key among its lines. Every distinct line
number of the order is one outlet that covers the deal, each in its own words, so the expected parse of every
headline is known from the keys and can be stated in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-07-30 18:00:00"            # the clock of the run
PREVIOUS = "2001-07-28 06:00:00"       # the previous successful run
SEC_DATE = "2001-07-01"
EXCLUDED = ("outlet_6",)
WIRES = ("outlet_1",)

SEGMENT_PHRASE = {"HOUSEHOLD": "wealth management", "AUTOMOBILE": "automotive", "MACHINERY": "machinery",
                  "FURNITURE": "furniture", "BUILDING": "real estate"}
STATES = ("WA", "OR", "ID", "CA", "NV", "AZ", "UT", "CO", "NM", "TX", "OK", "KS", "NE", "IA", "MO", "IL", "WI", "MN",
          "MI", "OH", "NY", "MA", "CT", "NJ", "FL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _short(name: Column) -> Column:
    """A ten-letter brand for a table name, so that different parties do not look alike."""
    return F.initcap(F.translate(F.substring(F.md5(name), 1, 10), "0123456789abcdef", "bcdfghjklmnpqrtv"))


def _segment(col: Column) -> Column:
    out = F.lit("")
    for k, v in SEGMENT_PHRASE.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def deals_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: parties, price, segment and the outlets (line numbers) that cover it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"), F.array_sort(F.collect_set("l_linenumber")).alias("outlets"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", _short(F.col("c_name")).alias("a"), _segment(F.col("c_mktsegment")).alias("seg"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", _short(F.col("s_name")).alias("b"))
    joined = (orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
              .join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(supplier, F.col("suppkey") == F.col("s_suppkey")))
    amount = F.floor(F.col("o_totalprice") / 1000) + 1
    big = F.col("o_orderkey") % 5 == 0
    return joined.select(
        F.col("o_orderkey").alias("deal_key"), "o_custkey", "suppkey", "a", "b", "seg", "outlets",
        F.col("o_orderdate").alias("day"),
        F.concat(F.lit("$"), amount.cast("string"), F.when(big, "B").otherwise("M")).alias("p"),
        (amount * F.when(big, F.lit(1e9)).otherwise(F.lit(1e6))).cast("double").alias("price"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed articles, deals and other headlines alike."""
    d = deals_src(spark, sf_dir).withColumn("outlet", F.explode("outlets"))
    kind = (F.col("deal_key") + F.col("outlet")) % 8
    a, b, seg, p = F.col("a"), F.col("b"), F.col("seg"), F.col("p")
    title = (F.when(kind == 0, F.concat(a, F.lit(" to acquire "), seg, F.lit(" firm "), b, F.lit(" for "), p))
             .when(kind == 1, F.concat(a, F.lit(" completes acquisition of "), b))
             .when(kind == 2, F.concat(b, F.lit(" agrees to be acquired by "), a))
             .when(kind == 3, F.concat(a, F.lit(" in talks to buy "), b))
             .when((kind == 4) & (seg == "wealth management"), F.concat(a, F.lit(" buys "), p, F.lit(" RIA "), b))
             .when(kind == 4, F.concat(a, F.lit(" takes minority stake in "), b))
             .when(kind == 5, F.concat(a, F.lit(" and "), b, F.lit(" to merge")))
             .when(kind == 6, F.concat(F.lit("Why "), a, F.lit(" deals keep getting bigger")))
             .otherwise(F.concat(a, F.lit(" Raises Stake in "), b)))
    published = F.col("day") + F.make_dt_interval(F.lit(0), F.col("outlet") * 5)
    return d.select(
        (F.col("deal_key") * 10 + F.col("outlet")).alias("id"), title.alias("title"),
        F.format_string("https://outlet_%d.example.com/Deals/%d/?utm_source=feed&id=%d#top", F.col("outlet").cast("int"),
                        F.col("deal_key"), F.col("deal_key")).alias("url"),
        F.format_string("outlet_%d", F.col("outlet").cast("int")).alias("source"),
        published.alias("published_at"),
        (published + F.make_dt_interval(F.lit(0), F.lit(1) + F.col("deal_key") % 5)).alias("fetched_at"),
        F.concat(F.lit("The "), seg, F.lit(" deal was reported by outlet "), F.col("outlet").cast("string")).alias("description"),
        "deal_key", kind.cast("int").alias("kind"), "o_custkey", "suppkey", "a", "b", "seg", "p", "price")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept articles with their deal key as the story group: cluster_id = smallest kept id of the deal."""
    from ..operators.deals import tagged_deals

    return tagged_deals(articles(spark, sf_dir)).withColumn("component", F.col("deal_key"))


def advisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered advisers: every customer (even crd) and every supplier (odd crd)."""
    c = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 2).alias("n"), _short(F.col("c_name")).alias("base"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("n"), _short(F.col("s_name")).alias("base"), F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("bal"))
    both = c.unionByName(s)
    n, bal = F.col("n"), F.col("bal")
    aum = F.when(bal > 0, F.floor(bal) * 1e6)
    states = F.array(*[F.lit(x) for x in STATES])
    mix = F.map_from_arrays(
        F.array(F.lit("a"), F.lit("b"), F.lit("f"), F.lit("g"), F.lit("m")),
        F.array(*[((n * k) % m).cast("double") * 1e6 for k, m in ((7, 11), (3, 5), (5, 13), (11, 7), (13, 3))]))
    mix = F.map_filter(mix, lambda k, v: v > 0)
    codes = lambda top, k: F.filter(F.sequence(F.lit(1), F.lit(top)), lambda i: (n * k + i) % 3 == 0)
    profile = F.struct(
        F.when(n % 4 == 0, F.concat(F.lit("WWW."), F.col("base"), F.lit(".COM"))).when(
            n % 4 == 1, F.concat(F.lit("http://"), F.lower("base"), F.lit(".com"))).alias("website"),
        (n % 50).cast("int").alias("employees"), (n % 400).alias("accounts"),
        (F.floor(bal) * 5e5).cast("double").alias("aum_discretionary"), mix.alias("client_aum"),
        codes(12, 1).alias("services"), codes(7, 2).alias("compensation"), codes(14, 5).alias("other_business"),
        (n % 6 == 0).alias("wrap"), (n % 10 == 3).alias("disclosures"), (n % 9 == 0).alias("approx_location"))
    return both.select(
        n.cast("string").alias("crd"), F.concat(F.lit("801-"), n.cast("string")).alias("sec_number"),
        F.concat(F.upper("base"), F.lit(" CAPITAL PARTNERS, LLC")).alias("legal_name"),
        F.concat(F.col("base"), F.lit(" Capital Partners")).alias("business_name"),
        F.concat(F.lit("CITY "), F.col("nation").cast("string")).alias("city"),
        F.get(states, F.col("nation") % 25).alias("state"), aum.cast("double").alias("aum_usd"),
        F.lit(SEC_DATE).alias("data_date"),
        F.when(n % 17 != 0, F.lpad(((n * 37) % 100000).cast("string"), 5, "0")).alias("zip"),
        F.when(n % 23 == 0, F.lit("Canada")).otherwise(F.lit("United States")).alias("country"), profile.alias("profile"))


def zip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP centroids spread over the lower 48 states, one per distinct code drawn from the part keys."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").groupBy(
        F.lpad(((k * 74) % 100000).cast("string"), 5, "0").alias("zip")).agg(
        F.min(F.lit(30.0) + (k * 7919 % 1500) / 100).alias("lat"),
        F.min(F.lit(-120.0) + (k * 104729 % 4000) / 100).alias("lon"))


def source_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlet settings for every outlet seen in the lines."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    n = F.col("n")
    return seen.select(
        F.format_string("outlet_%d", n.cast("int")).alias("name"),
        F.when(n == 1, "wire").otherwise("feed").alias("kind"),
        F.format_string("https://outlet_%d.example.com", n.cast("int")).alias("homepage"),
        (n == 5).alias("gated"), (n != 7).alias("enabled"), F.when(n <= 2, 3).otherwise(0).alias("max_age_days"),
        F.when(n == 3, "Energy & Utilities").alias("industry"))
