"""Map placement of advisers: composite Albers projection, fan-out and map queries, all as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_label
from ..functions.text import slug
from .firms import pretty_name

WIDTH, HEIGHT, SHARDS, CELL, SPACING = 975, 610, 32, 6, 0.55
GOLDEN = math.pi * (3 - math.sqrt(5))
# fixed values: scale, centre, and per inset rotation, centre, parallels, relative scale, shift and clip box
_K, _TX, _TY = 1300.0, 487.5, 305.0
_INSETS = [
    (96, (-0.6, 38.7), (29.5, 45.5), 1.0, (0.0, 0.0), (-0.455, -0.238, 0.455, 0.238)),
    (154, (-2, 58.5), (55, 65), 0.35, (-0.307, 0.201), (-0.425, 0.120, -0.214, 0.234)),
    (157, (-3, 19.9), (8, 18), 1.0, (-0.205, 0.212), (-0.214, 0.166, -0.115, 0.234)),
]
FOCUS = ("Wealth management", "Funds & alternatives", "Institutional", "Other")
# fixed values: filing codes and their labels
CLIENT_TYPES = dict(zip("abcdefghijklmn", (
    "Individuals", "High-net-worth individuals", "Banks and thrifts", "Investment companies", "Business development companies",
    "Pooled investment vehicles", "Pension and profit-sharing plans", "Charities", "State and municipal entities",
    "Other investment advisers", "Insurance companies", "Sovereign wealth funds", "Corporations", "Other clients")))
SERVICES = ("Financial planning", "Portfolio management for individuals", "Portfolio management for investment companies",
            "Portfolio management for pooled vehicles", "Portfolio management for institutions", "Pension consulting",
            "Selecting other advisers", "Newsletters and periodicals", "Security ratings or pricing", "Market timing",
            "Educational seminars", "Other services")
COMPENSATION = ("Percentage of AUM", "Hourly charges", "Subscription fees", "Fixed fees", "Commissions",
                "Performance-based fees", "Other")
OTHER_BUSINESS = ("Broker-dealer", "Registered representative of a broker-dealer", "Commodity pool operator or CTA",
                  "Futures commission merchant", "Real estate broker or agent", "Insurance broker or agent", "Bank",
                  "Trust company", "Municipal advisor", "Security-based swap dealer", "Major swap participant",
                  "Accounting firm", "Law firm", "Other financial product sales")
F_PAGE, F_DEAL, F_DISCLOSURE, F_WRAP = 1, 2, 4, 8


def _inset(lon: Column, lat: Column, inset) -> tuple[Column, Column, Column]:
    rotate, centre, parallels, rel, shift, box = inset
    rad = math.pi / 180
    y0, y1 = parallels[0] * rad, parallels[1] * rad
    n = (math.sin(y0) + math.sin(y1)) / 2
    c = 1 + math.sin(y0) * (2 * n - math.sin(y0))
    r0 = math.sqrt(c) / n
    k = _K * rel

    def plain(x: float, y: float) -> tuple[float, float]:
        r = math.sqrt(max(c - 2 * n * math.sin(y), 0)) / n
        return r * math.sin(x * n), r0 - r * math.cos(x * n)

    cx, cy = plain(centre[0] * rad, centre[1] * rad)
    dx, dy = _TX + shift[0] * _K - k * cx, _TY + shift[1] * _K + k * cy
    lam = F.pmod(lon * rad + rotate * rad + math.pi, F.lit(2 * math.pi)) - math.pi
    r = F.sqrt(F.greatest(F.lit(c) - F.sin(lat * rad) * (2 * n), F.lit(0.0))) / n
    x = F.lit(dx) + r * F.sin(lam * n) * k
    y = F.lit(dy) - (F.lit(r0) - r * F.cos(lam * n)) * k
    inside = (x.between(_TX + box[0] * _K, _TX + box[2] * _K)) & (y.between(_TY + box[1] * _K, _TY + box[3] * _K))
    return x, y, inside


def project(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add x, y on a 975 x 610 map; null outside the three insets."""
    tries = [_inset(F.col(lon), F.col(lat), i) for i in _INSETS]
    out = df
    for n, (x, y, inside) in enumerate(tries):
        out = out.withColumn(f"_p{n}", F.when(inside, F.struct(x.alias("x"), y.alias("y"))))
    p = F.coalesce(*[F.col(f"_p{n}") for n in range(len(tries))])
    return out.withColumn("x", p["x"]).withColumn("y", p["y"]).drop(*[f"_p{n}" for n in range(len(tries))])


def zip3_centroids(zips: DataFrame) -> DataFrame:
    return zips.groupBy(F.substring("zip", 1, 3).alias("zip3")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def locate(advisers: DataFrame, zips: DataFrame) -> DataFrame:
    """Adviser rows with lat, lon: exact ZIP, else the mean of its three-digit area; none outside the country."""
    domestic = F.lower(F.trim(F.coalesce("country", F.lit("United States")))).isin("united states", "usa", "us")
    exact = zips.select("zip", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    area = zip3_centroids(zips).select(F.col("zip3").alias("_z3"), F.col("lat").alias("_la3"), F.col("lon").alias("_lo3"))
    j = advisers.join(exact, "zip", "left").join(area, F.substring("zip", 1, 3) == F.col("_z3"), "left")
    how = F.when(~domestic, F.lit(None)).when(F.col("_la").isNotNull(), "exact").when(F.col("_la3").isNotNull(), "zip3")
    return j.withColumn("lat", F.when(domestic, F.coalesce("_la", "_la3"))).withColumn(
        "lon", F.when(domestic, F.coalesce("_lo", "_lo3"))).withColumn("placed_by", how).drop("_la", "_lo", "_la3", "_lo3", "_z3")


def fan_out(points: DataFrame, key: str = "crd") -> DataFrame:
    """Advisers at one spot spread into a sunflower around it, in key order.

    Ranks come from a range-sorted count per spot, so one crowded spot is never sorted in a single task: keys of a
    spot are first counted per prefix bucket and the rank is the bucket offset plus the rank inside the bucket.
    """
    p = points.withColumn("rx", F.bround("x", 2)).withColumn("ry", F.bround("y", 2)).withColumn(
        "bucket", F.substring(key, 1, 4))
    sizes = p.groupBy("rx", "ry", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("rx", "ry").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("rx", "ry", "bucket", F.coalesce(offset, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("rx", "ry", "bucket").orderBy(key)) - 1
    r = p.withColumn("i", inside).join(offsets, ["rx", "ry", "bucket"]).withColumn("i", F.col("i") + F.col("before"))
    radius, angle = F.sqrt(F.col("i")) * SPACING, F.col("i") * GOLDEN
    return r.withColumn("x", F.when(F.col("i") == 0, F.col("rx")).otherwise(F.col("rx") + radius * F.cos(angle))).withColumn(
        "y", F.when(F.col("i") == 0, F.col("ry")).otherwise(F.col("ry") + radius * F.sin(angle))).drop("rx", "ry", "bucket", "before")


def placed(advisers: DataFrame, zips: DataFrame) -> DataFrame:
    """Advisers on the map (those without a position are left out)."""
    return fan_out(project(locate(advisers, zips)).where("x is not null")).drop("i")


def map_totals(advisers: DataFrame, zips: DataFrame) -> DataFrame:
    p = project(locate(advisers, zips))
    on = F.col("x").isNotNull()
    bare = F.coalesce(F.nullif(F.col("zip"), F.lit("")), F.nullif(F.col("country"), F.lit("")), F.nullif(F.col("city"), F.lit(""))).isNull()
    return p.agg(F.count(F.lit(1)).alias("advisers"), F.count_if(on).alias("mapped"), F.count_if(~on).alias("unmapped"),
                 F.count_if(on & F.col("profile.approx_location")).alias("approximate"),
                 F.count_if(~on & bare).alias("no_address"),
                 F.bround(F.sum(F.when(on, F.coalesce("aum_usd", F.lit(0.0))))).alias("total_aum_usd"))


def client_focus(mix: Column) -> Column:
    """0 individuals, 1 funds, 2 institutional, 3 none: the largest part, ties to the lower code."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)
    part = lambda keys: total(F.map_filter(mix, lambda k, v: k.isin(*keys)))
    ind, fun, all_ = part("ab"), part("def"), total(mix)
    ins = all_ - ind - fun
    return F.when(F.coalesce(all_, F.lit(0.0)) <= 0, 3).when((ind >= fun) & (ind >= ins), 0).when(fun >= ins, 1).otherwise(2)


def client_mix(advisers: DataFrame) -> DataFrame:
    """Up to six client types per adviser with their rounded share, largest first."""
    total = F.aggregate(F.map_values("profile.client_aum"), F.lit(0.0), lambda a, v: a + v)
    rows = F.transform(F.map_entries("profile.client_aum"), lambda e: F.struct(
        (-e["value"]).alias("neg"), e["key"].alias("code"), F.bround(e["value"] * 100 / total).cast("int").alias("pct")))
    top = F.slice(F.filter(F.array_sort(rows), lambda r: r["pct"] >= 1), 1, 6)
    return advisers.where(F.size(F.map_keys("profile.client_aum")) > 0).select(
        "crd", F.posexplode(top).alias("pos", "r")).select("crd", (F.col("pos") + 1).alias("rank"), "r.code", "r.pct")


def bit_mask(codes: Column) -> Column:
    """Codes 1..n packed as bits."""
    return F.aggregate(codes, F.lit(0), lambda acc, c: acc.bitwiseOR(F.pow(F.lit(2.0), c - 1).cast("int")))


def labels_of(codes: Column, labels: tuple[str, ...]) -> Column:
    table = F.array(*[F.lit(x) for x in labels])
    return F.transform(F.filter(codes, lambda c: (c >= 1) & (c <= len(labels))), lambda c: F.get(table, c - 1))


def website(value: Column) -> Column:
    v = F.lower(F.trim(value))
    bad = F.coalesce(v, F.lit("")).isin("") | F.contains(v, F.lit(" ")) | ~F.contains(v, F.lit("."))
    return F.when(bad, F.lit(None)).when(v.rlike("^https?://"), v).otherwise(F.concat(F.lit("https://"), v))


def flags(page: Column, recent_deal: Column, disclosures: Column, wrap: Column) -> Column:
    bit = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    return bit(page, F_PAGE) + bit(recent_deal, F_DEAL) + bit(disclosures, F_DISCLOSURE) + bit(wrap, F_WRAP)


def is_recent(date: Column, now: Column, days: int = 14) -> Column:
    return date >= now - F.make_dt_interval(F.lit(days))


def recent_deals(linked: DataFrame, now: Column, keep: int = 3, days: int = 14) -> DataFrame:
    """Per adviser: up to `keep` newest deals of either role and whether one is recent.

    A top-k window filter on the adviser key lets Spark prune rows before the shuffle.
    """
    sides = linked.select("deal_date", "cluster_id", "headline", F.explode(F.array(
        F.struct(F.lit("acquirer").alias("role"), F.col("acquirer_crd").alias("crd")),
        F.struct(F.lit("target").alias("role"), F.col("target_crd").alias("crd")))).alias("s")).select(
        "deal_date", "cluster_id", "headline", "s.*").where("crd is not null")
    w = Window.partitionBy("crd").orderBy(F.desc("deal_date"), F.desc("cluster_id"), "role")
    top = sides.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    return top.withColumn("recent", is_recent(F.col("deal_date"), now, days))


def compact(advisers: DataFrame, zips: DataFrame, pages: DataFrame, deals: DataFrame) -> DataFrame:
    """One compact map row per placed adviser, largest first. `pages` and `deals` are keyed by crd."""
    recent = deals.groupBy("crd").agg(F.bool_or("recent").alias("recent"))
    p = placed(advisers, zips).join(pages.select("crd", F.lit(True).alias("page")), "crd", "left").join(recent, "crd", "left")
    name = pretty_name(F.coalesce("business_name", "legal_name"))
    return p.select(
        F.col("crd").cast("bigint").alias("crd"), name.alias("name"), F.round("x", 1).alias("x"), F.round("y", 1).alias("y"),
        F.coalesce(F.bround("aum_usd"), F.lit(0.0)).cast("bigint").alias("aum_usd"), F.initcap(F.lower("city")).alias("city"),
        "state", client_focus(F.col("profile.client_aum")).alias("focus"), bit_mask(F.col("profile.services")).alias("services"),
        flags(F.col("page"), F.col("recent"), F.col("profile.disclosures"), F.col("profile.wrap")).alias("flags")).orderBy(
        F.desc("aum_usd"), "crd")


def details(advisers: DataFrame, pages: DataFrame, deals: DataFrame) -> DataFrame:
    """Detail record per adviser with its shard number."""
    mix = client_mix(advisers).groupBy("crd").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "pct"))).alias("mix"))
    own = deals.groupBy("crd").agg(F.array_sort(F.collect_list(F.struct("n", "deal_date", "role", "headline"))).alias("deals"))
    j = advisers.join(mix, "crd", "left").join(own, "crd", "left").join(pages.select("crd", F.lit(True).alias("page")), "crd", "left")
    aum, acc = F.col("aum_usd"), F.col("profile.accounts")
    name = pretty_name(F.coalesce("business_name", "legal_name"))
    return j.select(
        "crd", F.pmod(F.col("crd").cast("bigint"), F.lit(SHARDS)).cast("int").alias("shard"),
        pretty_name(F.col("legal_name")).alias("legal_name"), "zip", F.coalesce("profile.approx_location", F.lit(False)).alias("approx_location"),
        website(F.col("profile.website")).alias("website"), F.col("profile.employees").alias("employees"), acc.alias("accounts"),
        F.when((aum > 0) & (acc > 0), F.bround(aum / acc)).cast("bigint").alias("avg_account_usd"),
        F.when((aum > 0) & (F.col("profile.aum_discretionary") > 0), F.bround(F.col("profile.aum_discretionary") * 100 / aum)).cast("bigint").alias("discretionary_pct"),
        "mix", labels_of(F.col("profile.services"), SERVICES).alias("services"),
        labels_of(F.col("profile.compensation"), COMPENSATION).alias("compensation"),
        labels_of(F.col("profile.other_business"), OTHER_BUSINESS).alias("other_business"),
        F.coalesce("profile.disclosures", F.lit(False)).alias("disclosures"),
        F.when(F.col("page"), F.concat(slug(name), F.lit("-"), F.col("crd"))).alias("slug"), "deals")


# ---------------------------------------------------------------- map queries
def map_filter(firms: DataFrame, min_aum: int = 0, service: int = 0, in_news: bool = False, focus: tuple[int, ...] = ()) -> DataFrame:
    out = firms
    if min_aum:
        out = out.where(F.col("aum_usd") >= min_aum)
    if service:
        out = out.where(F.col("services").bitwiseAND(1 << (service - 1)) != 0)
    if in_news:
        out = out.where(F.col("flags").bitwiseAND(F_PAGE | F_DEAL) != 0)
    return out.where(F.col("focus").isin(*focus)) if focus else out


def viewport(firms: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return firms.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def viewport_totals(firms: DataFrame) -> DataFrame:
    return firms.agg(F.count(F.lit(1)).alias("advisers"), F.sum("aum_usd").alias("aum_usd")).withColumn(
        "label", money_label(F.col("aum_usd").cast("double")))


def search(firms: DataFrame, text: str, limit: int = 8) -> DataFrame:
    q = text.strip().lower()
    if len(q) < 2:
        return firms.limit(0)
    hay = F.lower(F.concat_ws(" ", "name", "city"))
    return firms.where(F.contains(hay, F.lit(q))).orderBy(F.desc("aum_usd"), "crd").limit(limit)


def grid_cell(df: DataFrame) -> DataFrame:
    return df.withColumn("cx", F.floor(F.col("x") / CELL)).withColumn("cy", F.floor(F.col("y") / CELL))


def nearest(points: DataFrame, firms: DataFrame, key: str, reach: float = CELL) -> DataFrame:
    """Nearest adviser within `reach` (at most one cell) of each point: each point probes its nine cells."""
    if reach > CELL:
        raise ValueError("reach is limited to one grid cell")
    p = grid_cell(points.select(key, F.col("px").alias("x"), F.col("py").alias("y"))).select(
        key, F.col("x").alias("px"), F.col("y").alias("py"),
        F.explode(F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda j: F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")))))).alias("c")).select(
        key, "px", "py", "c.cx", "c.cy")
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    d = F.sqrt(dx * dx + dy * dy)  # hypot may lie one bit above a distance that is exactly the reach
    near = p.join(grid_cell(firms).select("cx", "cy", "x", "y", "crd"), ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= reach)
    return near.groupBy(key).agg(F.min_by("crd", F.struct("d", "crd")).alias("crd"), F.min("d").alias("distance"))
