"""Story rollups, deal rows, firm pages, trending lists and weekly recaps.

`items` below means kept articles with: id, title, url, source, published_at, fetched_at, description,
industries, deal (struct) and component (story group key). Every rollup is one groupBy on the group key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.money import round_to
from ..functions.text import slug
from ..functions.urls import clean_link
from ..rules import AUM_INDUSTRIES, WEALTH
from ..session import small_side
from .deals import STAGE_RANK, stage_rank
from .firms import pretty_name
from .industry import in_rule_order, union_of


def _order(*cols: str) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def cluster_rollup(items: DataFrame, by: str = "component") -> DataFrame:
    """One row per story: smallest id, earliest headline, time bounds, outlet and item counts."""
    first = _order("published_at", "id")
    return items.groupBy(by).agg(
        F.min("id").alias("cluster_id"), F.min_by("title", first).alias("headline"),
        F.min_by("id", first).alias("headline_item_id"), F.min_by("url", first).alias("url"),
        F.min("fetched_at").alias("first_seen"), F.min("published_at").alias("first_published"),
        F.max("published_at").alias("last_published"), F.countDistinct("source").alias("outlet_count"),
        F.count(F.lit(1)).alias("item_count"),
        union_of(F.collect_set("industries")).alias("industries"))


def without_sources(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Remove excluded outlets before any story aggregate."""
    return items.join(small_side(excluded), "source", "left_anti")


def cluster_aum(items: DataFrame, by: str = "component") -> DataFrame:
    """AUM of the head item, else the most frequent member figure (smallest on ties)."""
    head = F.min_by("aum_usd", _order("published_at", "id"))
    return items.groupBy(by).agg(F.coalesce(head, F.mode("aum_usd", True)).alias("aum_usd"))


def without_aum(items: DataFrame, by: str = "component") -> DataFrame:
    """Stories in an AUM industry that state no AUM, the ones `registered_aum` looks at."""
    fits = F.arrays_overlap("industries", F.array(*[F.lit(i) for i in AUM_INDUSTRIES]))
    per = items.groupBy(by).agg(F.count("aum_usd").alias("stated"), F.bool_or(fits).alias("fits"))
    return per.where((F.col("stated") == 0) & F.col("fits")).select(by)


def registered_aum(items: DataFrame, advisers: DataFrame, by: str = "component") -> DataFrame:
    """Adviser-file AUM for stories with no headline AUM and exactly one subject firm in an AUM industry."""
    per = items.groupBy(by).agg(
        F.count("aum_usd").alias("stated"), F.min("subject_crd").alias("lo"), F.max("subject_crd").alias("hi"),
        F.bool_or(F.arrays_overlap("industries", F.array(*[F.lit(i) for i in AUM_INDUSTRIES]))).alias("fits"))
    one = per.where((F.col("stated") == 0) & (F.col("lo") == F.col("hi")) & F.col("fits"))
    sec = advisers.where(F.col("aum_usd") > 0).select(F.col("crd").alias("lo"), F.col("aum_usd").alias("sec_aum_usd"))
    return one.join(sec, "lo").select(by, F.col("lo").alias("sec_aum_crd"), "sec_aum_usd")


def best_deal(items: DataFrame, wires: tuple[str, ...], by: str = "component") -> DataFrame:
    """Best parse per story: most parties, wire items first, then time; highest stage; first stated price."""
    late = ~F.col("source").isin(*wires) if wires else F.lit(True)
    order = F.struct(late, F.col("published_at"), F.col("id"))
    d = F.col("deal")
    missing = 2 - (d["acquirer"] != "").cast("int") - (d["target"] != "").cast("int")
    rank = F.max(stage_rank(d["stage"]))
    stage_of = reduce(lambda other, sr: F.when(rank == sr[1], sr[0]).otherwise(other), STAGE_RANK.items(),
                      F.lit("announced"))
    priced = F.when(d["value_usd"].isNotNull(), order)
    return items.groupBy(by).agg(
        F.min("id").alias("cluster_id"), F.min_by("deal", F.struct(missing, order)).alias("best"),
        stage_of.alias("stage"), F.min_by(d["value_usd"], priced).alias("value_usd"),
        F.bool_or(~late).alias("press_release"), F.min("published_at").alias("deal_date"),
        union_of(F.collect_set("industries")).alias("industries"),
        F.min_by("title", F.struct("published_at", "id")).alias("headline"))


def deal_rows(items: DataFrame, wires: tuple[str, ...], by: str = "component") -> DataFrame:
    b = best_deal(items, wires, by)
    named = (F.col("best.acquirer") != "") & (F.col("best.target") != "")
    note = F.coalesce(F.get("best.notes", F.lit(0)), F.lit(""))
    note = F.when(F.col("press_release") & named & (note != ""), F.concat(
        F.lit("raised by a matching press release (was: "), note, F.lit(")"))).otherwise(note)
    return b.select(
        by, "cluster_id", F.nullif(F.col("best.acquirer"), F.lit("")).alias("acquirer"),
        F.nullif(F.col("best.target"), F.lit("")).alias("target"), F.col("best.deal_type").alias("deal_type"), "stage",
        "value_usd", F.when(named, "high").otherwise("low").alias("confidence"), note.alias("note"), "press_release",
        "deal_date", "industries", "headline")


def target_aum(items: DataFrame, wires: tuple[str, ...], by: str = "component") -> DataFrame:
    """Target AUM of wealth stories from the second parser: agreeing headlines may fill a missing figure,
    headlines that disagree on the parties blank the row. Expects a `wealth` struct per item."""
    late = ~F.col("source").isin(*wires) if wires else F.lit(True)
    order = F.struct(late, F.col("published_at"), F.col("id"))
    w = F.col("wealth")
    high = w["confidence"] == "high"
    pair = F.struct(F.lower(w["acquirer"]).alias("a"), F.lower(w["target"]).alias("t"))
    g = items.where(w.isNotNull()).groupBy(by).agg(
        F.min_by("wealth", F.struct(~high, order)).alias("best"),
        F.collect_set(F.when(high, pair)).alias("pairs"),
        F.collect_set(F.when(high & w["target_aum_usd"].isNotNull(), F.struct(
            pair["a"].alias("a"), pair["t"].alias("t"), w["target_aum_usd"].alias("aum")))).alias("figures"))
    first = F.struct(F.lower("best.acquirer").alias("a"), F.lower("best.target").alias("t"))

    def related(x: Column, y: Column) -> Column:
        return F.startswith(x, y) | F.startswith(y, x)

    agree = F.forall("pairs", lambda p: related(p["a"], first["a"]) & related(p["t"], first["t"]))
    same = F.array_distinct(F.transform(
        F.filter("figures", lambda f: (f["a"] == first["a"]) & (f["t"] == first["t"])), lambda f: f["aum"]))
    is_high = F.col("best.confidence") == "high"
    aum = F.coalesce(F.col("best.target_aum_usd"), F.when(is_high & (F.size(same) == 1), F.get(same, F.lit(0))))
    split = is_high & ~agree
    return g.select(
        by, F.when(split, F.lit("")).otherwise(F.col("best.acquirer")).alias("acquirer"),
        F.when(split, F.lit("")).otherwise(F.col("best.target")).alias("target"),
        F.when(~split, aum).alias("target_aum_usd"), F.when(split, "low").otherwise(F.col("best.confidence")).alias(
            "confidence"))


def with_target_aum(deals: DataFrame, legacy: DataFrame, by: str = "component") -> DataFrame:
    """Attach the wealth parser's figure when its target agrees with the deal row's target."""
    right = legacy.select(by, F.col("target").alias("_t"), F.col("target_aum_usd").alias("_aum"))
    a, b = F.lower("target"), F.lower("_t")
    fits = F.col("target").isNull() | (F.col("_t") == "") | F.contains(a, b) | F.contains(b, a)
    wealth = F.array_contains("industries", F.lit(WEALTH))
    return deals.join(right, by, "left").withColumn("target_aum_usd", F.when(wealth & fits, F.col("_aum"))).drop(
        "_t", "_aum")


def purge(items: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored rows that no longer announce a deal are removed; `items` may be the stored items or their firm rows (by `id`)."""
    return items.join(parsed.select("id"), "id", "left_semi")


# ---------------------------------------------------------------- ordering windows
def first_links(items: DataFrame, by: str = "component") -> DataFrame:
    """First link of every outlet of a story, in time order."""
    first = items.groupBy(by, "source").agg(
        F.min_by(F.struct(clean_link(F.col("url")).alias("url"), "published_at", "id"),
                 F.struct("published_at", "id")).alias("f"))
    return first.select(by, "source", "f.url", "f.published_at", "f.id")


def headline_pick(items: DataFrame, by: str = "component") -> DataFrame:
    """The earliest headline of each story, kept with partial aggregates."""
    first = items.groupBy(by).agg(F.min_by(F.struct("id", "title", "source"), F.struct("published_at", "id")).alias("f"))
    return first.select(by, "f.*")


def firm_order(links: DataFrame, by: str = "component") -> DataFrame:
    """Distinct firms of a story in order of appearance: position within item, items in time order.

    The first appearance per firm is found with a partial aggregate, so a firm repeated by many articles
    travels once per task.
    """
    first = links.groupBy(by, F.coalesce("crd", F.lower("name")).alias("firm_key")).agg(
        F.min(F.struct("published_at", "id", "pos")).alias("seen"),
        F.min_by(F.struct("name", "crd"), F.struct("published_at", "id", "pos")).alias("f"))
    w = Window.partitionBy(by).orderBy("seen", "firm_key")
    return first.select(by, "firm_key", "f.name", "f.crd", "seen").withColumn("n", F.row_number().over(w)).drop("seen")


# ---------------------------------------------------------------- snapshot frames
def firm_view(advisers: DataFrame) -> DataFrame:
    """Public attributes of an adviser."""
    name = pretty_name(F.coalesce(F.col("business_name"), F.col("legal_name")))
    shout = (F.col("city") == F.upper("city")) & (F.col("city") != F.lower("city"))
    return advisers.select(
        "crd", name.alias("name"), F.concat(slug(name), F.lit("-"), F.col("crd")).alias("slug"),
        F.when(shout, F.initcap(F.lower("city"))).otherwise(F.nullif(F.col("city"), F.lit(""))).alias("city"),
        F.nullif(F.col("state"), F.lit("")).alias("state"), pretty_name(F.col("legal_name")).alias("legal_name"),
        "sec_number", F.col("aum_usd").alias("sec_aum_usd"))


def story_outlets(items: DataFrame, sources: DataFrame, by: str = "component") -> DataFrame:
    """The outlets of each story with their first link, in time order."""
    kinds = sources.select(F.col("name").alias("source"), "kind")
    return first_links(items, by).join(small_side(kinds), "source", "left").groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("published_at", "id", F.col("source").alias("name"), "url", "kind")))
        .alias("outlets"))


def snapshot(items: DataFrame, links: DataFrame | None, advisers: DataFrame, sources: DataFrame, sec_date: str,
             wires: tuple[str, ...], by: str = "component") -> DataFrame:
    """Story rows with nested outlets, firms, states and deal. All aggregates share the story key, so after the
    first shuffle the joins between them reuse the same partitioning. Every joined frame has the story key once, so a
    frame whose columns are not asked for is not made. Without `links` the stories have no firms."""
    outlets = story_outlets(items, sources, by)
    view = firm_view(advisers).select("crd", F.col("name").alias("full"), "slug", "city", "state")
    if links is None:
        links = items.select(by, "published_at", "id", F.lit(0).alias("pos"), F.lit("").alias("name"), F.lit("").alias("crd")).limit(0)
    firms = firm_order(links, by).join(view, "crd", "left").groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(
            "n", F.coalesce("full", "name").alias("name"), "slug", "crd", F.col("slug").isNotNull().alias("verified"),
            "city", "state"))).alias("firms"))
    roll = cluster_rollup(items, by)
    aum = cluster_aum(items, by)
    sec = registered_aum(items, advisers, by)
    deals = deal_rows(items, wires, by).select(by, "acquirer", "target", "deal_type", "stage", "value_usd")
    joined = (roll.join(outlets, by, "left").join(firms, by, "left").join(aum, by, "left").join(sec, by, "left")
              .join(deals, by, "left"))
    aum_usd = F.coalesce("aum_usd", "sec_aum_usd")
    source = F.when(F.col("aum_usd").isNotNull(), "headline").when(F.col("sec_aum_usd").isNotNull(), "sec")
    empty = F.array().cast("array<struct<n:int,name:string,slug:string,crd:string,verified:boolean,city:string,"
                           "state:string>>")
    firms_col = F.coalesce("firms", empty)
    return joined.select(
        by, F.col("cluster_id").alias("id"), "headline", clean_link(F.col("url")).alias("url"),
        F.get("industries", F.lit(0)).alias("category"), "industries",
        F.struct("acquirer", "target", F.col("deal_type").alias("type"), "stage", "value_usd").alias("deal"),
        "first_published", "last_published", "first_seen", F.size("outlets").alias("outlet_count"),
        F.transform("outlets", lambda o: F.struct(o["name"], o["url"], o["published_at"], o["kind"])).alias("sources"),
        F.transform(firms_col, lambda f: F.struct(f["name"], f["slug"], f["crd"], f["verified"], f["city"],
                                                  f["state"])).alias("firms"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(firms_col, lambda f: f["state"])))).alias("states"),
        aum_usd.alias("aum_usd"), source.alias("aum_source"),
        F.when(source == "sec", F.lit(sec_date)).alias("sec_aum_as_of"),
        F.exists("outlets", lambda o: F.coalesce(o["kind"] == "wire", F.lit(False))).alias("press_release"))


def party_links(deals: DataFrame, firms: DataFrame, by: str = "component") -> DataFrame:
    """(story, role) -> the first verified firm of the story whose name contains the party name or the reverse."""
    parties = deals.select(by, F.explode(F.array(
        F.struct(F.lit("acquirer").alias("role"), F.col("acquirer").alias("party")),
        F.struct(F.lit("target").alias("role"), F.col("target").alias("party")))).alias("p")).select(by, "p.*").where(
        F.col("party").isNotNull())
    a, b = F.lower("party"), F.lower("name")
    hit = parties.join(firms, by).where(F.contains(a, b) | F.contains(b, a))
    return hit.groupBy(by, "role").agg(
        F.min_by(F.struct("party", "slug", "crd"), F.struct("n", "crd")).alias("l")).select(by, "role", "l.*")


def linked_deals(deals: DataFrame, links: DataFrame, by: str = "component") -> DataFrame:
    """Deal rows with the crd and slug of each linked party."""
    sides = links.groupBy(by).agg(*[
        F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("acquirer", "target")
        for c in ("crd", "slug")])
    return deals.join(sides, by, "left")


def with_aum_source(deals: DataFrame, advisers: DataFrame) -> DataFrame:
    """Target AUM from the headline, else from the adviser file of the linked target."""
    sec = advisers.where(F.col("aum_usd") > 0).select(F.col("crd").alias("target_crd"), F.col("aum_usd").alias("_sec"))
    out = deals.join(sec, "target_crd", "left")
    source = F.when(F.col("target_aum_usd").isNotNull(), "headline").when(F.col("_sec").isNotNull(), "sec")
    return out.withColumn("target_aum_source", source).withColumn(
        "target_aum_usd", F.coalesce("target_aum_usd", "_sec")).drop("_sec")


def firm_deals(linked: DataFrame) -> DataFrame:
    """One row per firm page and deal with the firm's role; the acquirer role wins when both fit."""
    both = linked.select("*", F.explode(F.array_distinct(F.array_compact(F.array("acquirer_slug", "target_slug")))).alias(
        "slug"))
    return both.withColumn("role", F.when(F.col("slug") == F.col("acquirer_slug"), "acquirer").otherwise("target"))


def firm_index(story_firms: DataFrame, by: str = "component") -> DataFrame:
    """Verified firms with the number of stories that name them."""
    return story_firms.where(F.col("crd").isNotNull()).select("crd", by).distinct().groupBy("crd").agg(
        F.count(F.lit(1)).alias("story_count"))


def trending(stories: DataFrame, story_firms: DataFrame, now: Column, days: int = 7, limit: int = 15,
             by: str = "component") -> DataFrame:
    """Firms named by the most distinct stories of the trailing days; ties by name."""
    recent = stories.where(F.col("last_published") >= now - F.make_dt_interval(F.lit(days))).select(by)
    pairs = story_firms.where(F.col("crd").isNotNull()).join(recent, by, "left_semi").select(
        by, "crd", "name").dropDuplicates([by, "crd"])
    return pairs.groupBy("crd").agg(F.count(F.lit(1)).alias("stories"), F.min("name").alias("name")).orderBy(
        F.desc("stories"), F.lower("name"), "crd").limit(limit)


# ---------------------------------------------------------------- weekly recap
def week_rows(deals: DataFrame, now: Column, date: str = "deal_date") -> DataFrame:
    """Deals between the Monday of the local week and today."""
    today = dates.local_day(now)
    day = dates.local_day(F.col(date))
    return deals.where((day >= dates.monday_of(today)) & (day <= today))


def weekly_totals(week: DataFrame, now: Column) -> DataFrame:
    today = dates.local_day(now)
    stated = F.when(F.col("target_aum_source") == "headline", F.col("target_aum_usd"))
    return week.agg(
        F.count(F.lit(1)).alias("deals"), F.sum(stated).alias("total_disclosed_aum_usd"),
        F.count(stated).alias("disclosed_aum_deals"), F.sum("value_usd").alias("total_disclosed_value_usd"),
        F.count("value_usd").alias("disclosed_value_deals")).select(
        dates.iso_week(today).alias("week"), dates.monday_of(today).cast("string").alias("start"),
        today.cast("string").alias("end"), "*")


def weekly_industries(week: DataFrame) -> DataFrame:
    return week.select(F.explode("industries").alias("industry")).groupBy("industry").agg(
        F.count(F.lit(1)).alias("deals")).orderBy(F.desc("deals"), "industry")


def weekly_top_acquirers(week: DataFrame, limit: int = 5, order: tuple[str, ...] = ("deal_date", "cluster_id")) -> DataFrame:
    """Acquirers by number of deals, keyed by crd else lower-cased name, shown under their newest spelling."""
    key = F.coalesce("acquirer_crd", F.lower("acquirer"))
    return week.where(F.col("acquirer").isNotNull()).groupBy(key.alias("k")).agg(
        F.count(F.lit(1)).alias("deals"), F.max_by("acquirer", _order(*order)).alias("name")).orderBy(
        F.desc("deals"), F.lower("name"), "k").limit(limit)


# ---------------------------------------------------------------- health and stats
def sources_health(config: DataFrame, status: DataFrame) -> DataFrame:
    """Configured outlets with their last run; a disabled outlet never shows an old status."""
    s = status.select(F.col("name").alias("_n"), "ok", "method", "items_last_run", "new_last_run", "dropped_last_run")
    on = F.col("enabled")
    j = config.join(s, F.col("name") == F.col("_n"), "left")
    return j.select(
        "name", "kind", "homepage", "enabled", (on & F.coalesce("ok", F.lit(False))).alias("ok"),
        F.when(on, F.coalesce("method", F.lit("not run"))).otherwise("disabled").alias("method"),
        *[F.when(on, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
          for c in ("items_last_run", "new_last_run", "dropped_last_run")])


def health_totals(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if("ok").alias("sources_ok"), F.count(F.lit(1)).alias("sources_total"))


def wire_stats(rows: DataFrame) -> DataFrame:
    """Per feed: fetched, too old, dropped by the filter, kept. Expects flags `fresh` and `is_deal`."""
    g = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("fresh") & ~F.col("is_deal")).alias("dropped_by_filter"),
        F.count_if(F.col("fresh") & F.col("is_deal")).alias("kept"))
    return g.withColumn("too_old", F.greatest(F.col("fetched") - F.col("kept") - F.col("dropped_by_filter"), F.lit(0)))


def upsert_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """One status row per outlet; a blank discovered address keeps the earlier one."""
    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in new.columns if c not in ("name", "discovered_url")]
    seen = F.col("n.name").isNotNull()
    return o.join(n, F.col("o.name") == F.col("n.name"), "full").select(
        F.coalesce("n.name", "o.name").alias("name"),
        F.coalesce(F.nullif(F.col("n.discovered_url"), F.lit("")), F.col("o.discovered_url")).alias("discovered_url"),
        *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols])


def item_aum(items: DataFrame) -> DataFrame:
    """Item AUM: only for two industries, from the headline else the teaser, dropped when it is the price."""
    from .amounts import aum_mention

    fits = F.arrays_overlap("industries", F.array(*[F.lit(i) for i in AUM_INDUSTRIES]))
    aum = F.coalesce(aum_mention(F.col("title")), aum_mention(F.col("description")))
    price = F.col("deal.value_usd")
    same = price.isNotNull() & (round_to(aum, 1e5) == round_to(price, 1e5))
    return items.withColumn("aum_usd", F.when(fits & ~F.coalesce(same, F.lit(False)), aum))
