"""Text columns: HTML to text, word-boundary truncation, suffix stripping, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hof import let

# fixed values: entities that feeds use in headlines; numeric entities are decoded by rule
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "copy": "©", "reg": "®",
    "trade": "™", "euro": "€", "pound": "£", "cent": "¢", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç",
    "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "amp": "&",
}
MAX_DESCRIPTION = 300
_SPACE = r"(?U)\s+"
_POSTED = r"(?s)\s*The post .{1,300}? appeared first on .{1,120}?\.?\s*$"
_MORE = r"(?i)\s*(?:\[(?:…|\.\.\.|&#8230;)\]|Read more\W*|Continue reading\W*|\(more…\))\s*$"


def unescape(text: Column) -> Column:
    """Decode named entities and numeric character references."""
    return let(text, lambda t: F.when(F.instr(t, "&") > 0, _decoded(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    pieces = F.split(text, r"(?=&#[xX]?[0-9A-Fa-f]{1,6};)|(?<=;)", -1)

    def numeric(p: Column) -> Column:
        hexa = F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        deci = F.regexp_extract(p, r"^&#([0-9]{1,6});$", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).cast("bigint")
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.isNull() | (code == 0) | (code > 0x10FFFF), p).otherwise(wide)

    decoded = F.when(F.instr(text, "&#") > 0, F.array_join(F.transform(pieces, numeric), "")).otherwise(text)
    return reduce(lambda t, e: F.replace(t, F.lit(f"&{e[0]};"), F.lit(e[1])), ENTITIES.items(), decoded)


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip_tags(text: Column) -> Column:
    """Drop scripts, styles, comments and tags."""
    t = F.regexp_replace(text, r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[a-zA-Z/!?][^>]*>", " ")


def html_text(value: Column) -> Column:
    """Markup to plain text without syndication boilerplate or 'read more' tails."""
    plain = F.when(F.instr(value, "<") > 0, strip_tags(value)).otherwise(value)
    t = squash(unescape(F.coalesce(plain, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(t, _POSTED, ""), _MORE, ""))


def clean_title(value: Column) -> Column:
    return squash(unescape(html_text(value)))


def truncate_words(value: Column, limit: int = MAX_DESCRIPTION) -> Column:
    """At most `limit` characters, cut at a word when the last space is past 60 percent of it."""
    v = F.trim(value)
    cut = F.substring(v, 1, limit - 1)
    tail = F.instr(F.reverse(cut), " ")  # 1-based from the right, 0 when there is no space
    space = F.lit(limit - 1) - tail      # zero-based position of the last space
    cut = F.when((tail > 0) & (space > limit * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.rtrim(cut, F.lit(" ,;:.-–—")), F.lit("…")))


def clean_description(value: Column) -> Column:
    return truncate_words(html_text(value))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


_SUFFIX_MARK = r"\s+[|\-–—:]\s+"


def _without_suffix(title: Column, name: Column, mark: str, dot_com: bool) -> Column:
    """Title without '<mark> name' at its end. The split is a fixed pattern; only a name that itself holds a mark
    needs a pattern built from the row."""
    def drop(t: Column) -> Column:
        cut = r"(?s)^(.*\S)" + mark + r"(.*?)\s*$"
        tail = F.lower(F.regexp_extract(t, cut, 2))
        same = tail.isin(F.lower(name), F.lower(F.concat(name, F.lit(".com")))) if dot_com else tail == F.lower(name)
        built = F.concat(F.lit("(?i)" + mark), _quoted(name), F.lit((r"(?:\.com)?" if dot_com else "") + r"\s*$"))
        return (F.when(F.coalesce(name, F.lit("")) == "", t)
                .when(name.rlike(mark), F.regexp_replace(t, built, F.lit("")))
                .when(same, F.regexp_replace(t, cut, "$1")).otherwise(t))

    return let(title, drop)


def strip_source_suffix(title: Column, source: Column) -> Column:
    """Drop a trailing '| Outlet' when it names the row's own source (full, unspaced or first word)."""
    t = _without_suffix(title, source, _SUFFIX_MARK, True)
    for other in (F.replace(source, F.lit(" "), F.lit("")), F.split(source, " ")[0]):
        t = _without_suffix(t, other, _SUFFIX_MARK, True)
    return F.trim(t)


def strip_outlet_suffix(title: Column, outlet: Column) -> Column:
    return F.trim(_without_suffix(title, outlet, r"\s+[-–—|]\s+", False))


def slug(text: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit("firm")).otherwise(s)


def words_of(text: Column) -> Column:
    """Lower-case word tokens used by the copied-run checks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9$%]+"), 0)
