"""Frames several queries share, kept for the life of a session (memory and disk) because parsing is the costly part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import amounts, feed, firms, rollups, wealth
from ..session import checkpointed, small_side
from . import frames, outputs

_KEPT: dict[tuple[int, str, str], DataFrame] = {}


def _keep(spark: SparkSession, sf: str, name: str, make, persist: bool = True) -> DataFrame:
    key = (id(spark.sparkContext), sf, name)
    if key not in _KEPT:
        _KEPT[key] = make().persist() if persist else make()
    return _KEPT[key]


def forget() -> None:
    for df in _KEPT.values():
        df.unpersist()
    _KEPT.clear()


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Kept articles with deal, industries and the deal key as `component`."""
    return _keep(spark, sf, "items", lambda: frames.items(spark, sf))


def items_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows for a query that reads them once: not stored (unless they are already), so only the columns it uses are made."""
    return _KEPT.get((id(spark.sparkContext), sf, "items")) or frames.items(spark, sf)


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return _keep(spark, sf, "dictionary", lambda: firms.dictionary(frames.advisers(spark, sf)))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return _keep(spark, sf, "matches", lambda: firms.match(slim_items(spark, sf).select("id", "title"), "id", "title",
                                                           dictionary(spark, sf)))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(id, firm_key, name, crd, pos, in_title) joined with the story key and time of the item."""
    def make() -> DataFrame:
        it = slim_items(spark, sf)
        l = item_links(spark, sf)
        return l.join(it.select("id", "component", "source", "published_at"), "id")
    return _keep(spark, sf, "links", make)


def item_links(spark: SparkSession, sf: str, it: DataFrame | None = None) -> DataFrame:
    """(id, firm_key, name, crd, pos, in_title) for a query that reads them once."""
    return firms.item_links(slim_items(spark, sf) if it is None else it, dictionary(spark, sf), frames.advisers(spark, sf))


def stored(df: DataFrame) -> DataFrame:
    """The frame as a compressed table, for a query that reads it several times."""
    return checkpointed(df)


def full_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with AUM and subject adviser. The subject is looked up for stories that state no AUM of their own in an AUM industry, the
    only ones it may stand in for."""
    def make() -> DataFrame:
        it = rollups.item_aum(items(spark, sf))
        open_ = it.join(small_side(checkpointed(rollups.without_aum(it))), "component", "left_semi").select("id", "title")
        found = firms.match(open_, "id", "title", dictionary(spark, sf))
        return it.join(firms.subjects(open_, "id", "title", found), "id", "left")
    return _keep(spark, sf, "full_items", make)


def slim_items(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of items that links and counts of stories need, stored as a compressed table."""
    return _keep(spark, sf, "slim_items", lambda: checkpointed(items_once(spark, sf).select(
        "id", "component", "source", "published_at", "title", "description")), persist=False)


def story_crds(spark: SparkSession, sf: str, among: DataFrame | None = None) -> DataFrame:
    """(component, crd): the verified firms of each story, or of the items given, without order and other names."""
    it = slim_items(spark, sf) if among is None else among
    keyed = it.select(F.struct("component", "id").alias("_k"), "title", "description")
    return firms.item_crds(keyed, dictionary(spark, sf), frames.advisers(spark, sf), "_k").select("_k.component", "crd").distinct()


def rows_of(items: DataFrame, stories: DataFrame) -> DataFrame:
    """The items of some stories."""
    return items.join(small_side(stories.select("component")), "component", "left_semi")


def recent_firms(spark: SparkSession, sf: str, days: int) -> tuple[DataFrame, DataFrame]:
    """The stories of the trailing days and (component, crd, name) of their verified firms; items of other stories are not read for firms."""
    it = slim_items(spark, sf)
    recent = checkpointed(it.groupBy("component").agg(F.max("published_at").alias("last_published")).where(
        F.col("last_published") >= frames.now() - F.make_dt_interval(F.lit(days))))
    view = rollups.firm_view(frames.advisers(spark, sf)).select("crd", "name")
    return recent, story_crds(spark, sf, rows_of(it, recent)).join(view, "crd")


def deal_rows_once(spark: SparkSession, sf: str) -> DataFrame:
    """Deal rows for a query that reads them once and needs neither assets nor linked firms."""
    return rollups.deal_rows(items_once(spark, sf), frames.WIRES)


def linked_deals(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Deal rows with linked parties, without assets: all, or the rows given, whose stories alone are read for firms."""
    all_rows = rows is None
    it = slim_items(spark, sf)
    rows = deal_rows_once(spark, sf) if all_rows else rows
    rows = checkpointed(rows)
    return rollups.linked_deals(rows, rollups.party_links(rows, firms_of(spark, sf, it if all_rows else rows_of(it, rows))))


def firms_of(spark: SparkSession, sf: str, items: DataFrame) -> DataFrame:
    """`story_firms` of the stories of some items."""
    l = firms.item_links(items, dictionary(spark, sf), frames.advisers(spark, sf))
    return _story_firms(spark, sf, l.join(items.select("id", "component", "source", "published_at"), "id"))


def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the public data sets. There is one deal row for each story, and a firm has a page when a story names it."""
    it = slim_items(spark, sf)
    stories = it.select("component").distinct()
    return outputs.dataset_counts(it, stories, stories, story_crds(spark, sf).select("crd").distinct())


def deals_among(spark: SparkSession, sf: str, wanted) -> DataFrame:
    """`deals` of the rows that `wanted` leaves of the deal rows: only their stories are read for firms and assets."""
    it = checkpointed(items_once(spark, sf).select("id", "component", "source", "published_at", "title", "description", "industries", "deal"))
    rows = checkpointed(wanted(rollups.deal_rows(it, frames.WIRES)))
    own = checkpointed(rows_of(it, rows))
    legacy = rollups.target_aum(wealth.parse_wealth(own), frames.WIRES)
    linked = rollups.linked_deals(rows, rollups.party_links(rows, firms_of(spark, sf, own)))
    return rollups.with_aum_source(rollups.with_target_aum(linked, legacy), frames.advisers(spark, sf))


def deals(spark: SparkSession, sf: str) -> DataFrame:
    """Deal rows with target AUM, linked parties and AUM source."""
    def make() -> DataFrame:
        it = items(spark, sf)
        rows = rollups.deal_rows(it, frames.WIRES)
        legacy = rollups.target_aum(wealth.parse_wealth(it), frames.WIRES)
        rows = rollups.with_target_aum(rows, legacy)
        rows = rollups.linked_deals(rows, rollups.party_links(rows, story_firms(spark, sf)))
        return rollups.with_aum_source(rows, frames.advisers(spark, sf))
    return _keep(spark, sf, "deals", make)


def story_firms(spark: SparkSession, sf: str) -> DataFrame:
    """(component, n, name, crd, slug) firms per story in order of appearance."""
    return _keep(spark, sf, "story_firms", lambda: _story_firms(spark, sf, links(spark, sf)))


def _story_firms(spark: SparkSession, sf: str, links: DataFrame) -> DataFrame:
    view = rollups.firm_view(frames.advisers(spark, sf)).select("crd", F.col("name").alias("full"), "slug", "state")
    f = rollups.firm_order(links).join(view, "crd", "left")
    return f.select("component", "n", F.coalesce("full", "name").alias("name"), "crd", "slug", "state")


def stories(spark: SparkSession, sf: str) -> DataFrame:
    return _keep(spark, sf, "stories", lambda: stories_once(spark, sf))


def stories_once(spark: SparkSession, sf: str) -> DataFrame:
    """The story rollup for a query that reads it once."""
    return rollups.cluster_rollup(items_once(spark, sf))


def snapshot(spark: SparkSession, sf: str, firms: bool = True, subjects: bool = True) -> DataFrame:
    """Story rows, made anew from the stored items with the columns a query uses. Queries that use no column of firms (`firms`,
    `states`) or no assets (`aum_usd`, `aum_source`, `sec_aum_as_of`) need no firms linked for them."""
    it = full_items(spark, sf) if subjects else items(spark, sf).select(
        "*", F.lit(None).cast("double").alias("aum_usd"), F.lit(None).cast("string").alias("subject_crd"))
    return rollups.snapshot(it, links(spark, sf) if firms else None, frames.advisers(spark, sf), frames.source_config(spark, sf),
                            frames.SEC_DATE, frames.WIRES)


def top_snapshot(spark: SparkSession, sf: str, start: Column, n: int) -> DataFrame:
    """Ranked stories of the window as rows of the snapshot: the rank is decided by the rollup, so only the stories shown are made whole."""
    it = items_once(spark, sf)
    top = feed.top_stories(rollups.cluster_rollup(it).withColumnRenamed("cluster_id", "id"), start, n)
    top = checkpointed(top.select("component", "rank"))
    own = checkpointed(rows_of(it, top))
    own = rollups.item_aum(own)
    found = firms.match(own, "id", "title", dictionary(spark, sf))
    full = checkpointed(own.join(firms.subjects(own, "id", "title", found), "id", "left"))
    l = firms.item_links(full, dictionary(spark, sf), frames.advisers(spark, sf)).join(full.select("id", "component", "source", "published_at"), "id")
    s = rollups.snapshot(full, l, frames.advisers(spark, sf), frames.source_config(spark, sf), frames.SEC_DATE, frames.WIRES)
    return s.join(F.broadcast(top), "component")


def map_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import geo

    def make() -> DataFrame:
        pages = rollups.firm_index(story_crds(spark, sf))
        # a deal marks its firms while it is recent
        fresh = linked_deals(spark, sf, deal_rows_once(spark, sf).where(geo.is_recent(F.col("deal_date"), frames.now())))
        return geo.compact(frames.advisers(spark, sf), frames.zip_points(spark, sf), pages, geo.recent_deals(fresh, frames.now()))
    return _keep(spark, sf, "map", make)


def mention_rows(spark: SparkSession, sf: str) -> DataFrame:
    return amounts.mentions(frames.articles(spark, sf), "id", "title")
