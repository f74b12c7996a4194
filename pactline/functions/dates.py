"""Date columns: mixed-format parsing, sanity fixes and local calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hof import let

LOCAL_ZONE = "America/Los_Angeles"
_WEEKDAY = r"(?i)^\s*(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
_HUMAN = (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\b")
_NUMERIC = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
# fixed values: zone names allowed by RFC 822
_ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
          "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


# layouts by shape; a layout is tried only on text of its shape, since a failed parse is expensive
_SHAPES = [
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$", "d MMM yyyy HH:mm:ss Z", True),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d [+-]\d{4}$", "d MMM yyyy HH:mm Z", True),
    (r"^\d{1,2} [A-Za-z]{3} \d\d \d\d:\d\d:\d\d [+-]\d{4}$", "d MMM yy HH:mm:ss Z", True),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [+-]\d{4}$", "yyyy-MM-dd HH:mm:ss Z", True),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d [+-]\d{4}$", "yyyy-MM-dd HH:mm Z", True),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss", False),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d$", "yyyy-MM-dd HH:mm", False),
    (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd", False),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d$", "d MMM yyyy HH:mm:ss", False),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d$", "d MMM yyyy HH:mm", False),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy", False),
]


def _instant(text: Column, zoned: bool) -> Column:
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)))
                        for shape, layout, has_zone in _SHAPES if has_zone == zoned])


def parse_date(value: Column, zone: str = LOCAL_ZONE) -> Column:
    """RFC 822, ISO 8601 and common human forms to an instant; values without a zone are local."""
    def with_offset(v: Column) -> Column:
        out = v
        for name, offset in _ZONES.items():
            out = F.regexp_replace(out, rf"(?<=[\d ]){name}$", offset)
        return F.when(v.rlike("[A-Z]$"), out).otherwise(v)   # only a text that ends in a letter names a zone

    def tidy(v: Column) -> Column:
        v = F.regexp_replace(v, r"([+-]\d\d):(\d\d)$", "$1$2")
        v = F.regexp_replace(v, r"(?i)^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d(?::\d\d)?)(?:[.,]\d+)?\s*", "$1 $2 ")
        return F.trim(F.regexp_replace(v, r"\s+", " "))

    def parsed(v: Column) -> Column:
        zoned, naive = _instant(v, True), _instant(v, False)
        month = F.initcap(F.lower(F.regexp_extract(v, _HUMAN, 1)))
        human = F.when(month != "", F.try_to_timestamp(
            F.concat_ws(" ", F.regexp_extract(v, _HUMAN, 2), month, F.regexp_extract(v, _HUMAN, 3)), F.lit("d MMM yyyy")))
        numeric = F.when(v.rlike(_NUMERIC), F.try_to_timestamp(
            F.concat_ws("/", *[F.regexp_extract(v, _NUMERIC, i) for i in (1, 2, 3)]), F.lit("M/d/yyyy")))
        return F.coalesce(zoned, F.to_utc_timestamp(F.coalesce(naive, human, numeric), zone))

    # each text is tidied once, not once for every layout that looks at it
    return let(let(F.regexp_replace(F.trim(value), _WEEKDAY, ""), lambda v: tidy(with_offset(v))), parsed)


def published_or_fetched(published: Column, fetched: Column) -> Column:
    """struct<at, estimated>: missing or more than a day ahead falls back to the fetch time."""
    def checked(at: Column) -> Column:
        bad = at.isNull() | (at > fetched + F.expr("INTERVAL 1 DAY"))
        return F.struct(F.when(bad, fetched).otherwise(at).alias("at"), bad.alias("estimated"))

    return let(published, checked)


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def monday_of(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def iso_week(day: Column) -> Column:
    """'2026-W39' (the ISO year belongs to the Thursday of the week)."""
    thursday = F.date_add(monday_of(day), 3)
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
