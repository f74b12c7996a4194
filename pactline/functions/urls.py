"""URL columns: the canonical form used as a key and the cleaned form used for outgoing links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: pure tracking parameters (any utm_* parameter is dropped as well)
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "cmpid", "sr_share", "dclid", "msclkid")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def host(url: Column) -> Column:
    """Lower-case host name without credentials and port."""
    return F.regexp_extract(F.lower(_part(F.trim(url), 2)), r"^(?:[^@]*@)?([^:]*)", 1)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return _part(F.trim(url), 3)


def _recode(text: Column) -> Column:
    """One spelling per value: decode, then encode as a form value."""
    plain = ~text.rlike(r"[^A-Za-z0-9_.~-]")
    return F.when(plain, text).otherwise(F.regexp_replace(
        F.url_encode(F.try_url_decode(text)), r"\*", "%2A"))


def _kept_pairs(query: Column) -> Column:
    """array<struct<k,v>> without tracking parameters; a bare name counts as an empty value."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.regexp_extract(p, r"^([^=]*)", 1).alias("k"),
            F.regexp_replace(p, r"^[^=]*=?", "").alias("v")))
    return F.filter(
        pairs, lambda p: ~F.startswith(F.lower(p["k"]), F.lit("utm_")) & ~F.lower(p["k"]).isin(*TRACKING))


def _query_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_recode(p["k"]), F.lit("="), _recode(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    u = F.trim(url)
    scheme = F.lower(_part(u, 1))
    port = F.regexp_extract(_part(u, 2), r":(\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    netloc = F.when(default, host(u)).otherwise(F.concat(host(u), F.lit(":"), port))
    query = _query_text(F.array_sort(_kept_pairs(_part(u, 4))))
    return F.concat(
        scheme, F.lit("://"), netloc, F.regexp_replace(_part(u, 3), "/+$", ""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def clean_link(url: Column) -> Column:
    u = F.trim(url)
    query = _query_text(_kept_pairs(_part(u, 4)))
    return F.concat(
        _part(u, 1), F.lit("://"), _part(u, 2), _part(u, 3),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link found on a page against the page address."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(
        F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), href)).when(
        F.startswith(href, F.lit("/")), F.concat(root, href)).when(
        F.startswith(href, F.lit("#")) | F.startswith(href, F.lit("?")),
        F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href)).otherwise(
        F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), href))
