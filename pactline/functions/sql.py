"""Functions for `spark.sql`: plain SQL bodies, so that they are inlined and optimised like any other expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.feeds import _ANCHOR, _BLOCK, _NO_CONTENT
from .urls import _PARTS, TRACKING


def _raw(pattern: str) -> str:
    """A regular expression as a raw string literal; a quote inside is written as its code point."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _recoded(text: str) -> str:
    return rf"if({text} rlike r'[^A-Za-z0-9_.~-]', replace(url_encode(try_url_decode({text})), '*', '%2A'), {text})"


def _query_text(pairs: str) -> str:
    return f"array_join(transform({pairs}, p -> {_recoded('p.k')} || '=' || {_recoded('p.v')}), '&')"


def _part(i: int) -> str:
    return f"regexp_extract(trim(url), {_raw(_PARTS)}, {i})"


_HOST = rf"regexp_extract(lower({_part(2)}), r'^(?:[^@]*@)?([^:]*)', 1)"
_PORT = rf"regexp_extract({_part(2)}, r':(\d+)$', 1)"
_PAIRS = (rf"filter(transform(filter(split({_part(4)}, '&'), q -> q <> ''), q -> named_struct('k', regexp_extract(q, r'^([^=]*)', 1), "
          rf"'v', regexp_replace(q, r'^[^=]*=?', ''))), p -> lower(p.k) not like r'utm\_%' and lower(p.k) not in ({', '.join(repr(t) for t in TRACKING)}))")
_DEFAULT_PORT = f"({_PORT} = '' or (lower({_part(1)}) = 'http' and {_PORT} = '80') or (lower({_part(1)}) = 'https' and {_PORT} = '443'))"


def _with_query(pairs: str) -> str:
    return f"if({_query_text(pairs)} <> '', '?' || {_query_text(pairs)}, '')"


_NORM = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' '))"
_HREF = r"(?is)^<[^>]*?\bhref\s*=\s*(\"[^\"]*\"|\x27[^\x27]*\x27)"

# name and arguments, result, body
SCALARS = (
    ("url_host(url string)", "string", _HOST),
    ("url_bare_host(url string)", "string", f"regexp_replace({_HOST}, r'^www\\.', '')"),
    ("url_canonical(url string)", "string",
     f"concat(lower({_part(1)}), '://', if({_DEFAULT_PORT}, {_HOST}, {_HOST} || ':' || {_PORT}), regexp_replace({_part(3)}, '/+$', ''), "
     f"{_with_query(f'array_sort({_PAIRS})')})"),
    ("url_clean(url string)", "string", f"concat({_part(1)}, '://', {_part(2)}, {_part(3)}, {_with_query(_PAIRS)})"),
    ("headline_norm(title string)", "string", _NORM),
    ("headline_jaccard(a string, b string)", "double",
     "try_divide(size(array_intersect(split(headline_norm(a), ' '), split(headline_norm(b), ' '))), "
     "size(array_union(split(headline_norm(a), ' '), split(headline_norm(b), ' '))))"),
)
TABLES = (
    ("page_links(html string)", "pos int, href string, label string",
     f"select pos, regexp_replace(regexp_extract(a, {_raw(_HREF)}, 1), r'^[\"\\x27]|[\"\\x27]$', ''), "
     f"trim(regexp_replace(regexp_replace(a, r'(?s)<[a-zA-Z/!?][^>]*>', ' '), r'(?U)\\s+', ' ')) from (select posexplode(flatten(transform("
     f"regexp_extract_all(regexp_replace(html, {_raw(_NO_CONTENT)}, ' '), {_raw(_BLOCK)}, 0), b -> regexp_extract_all(b, {_raw(_ANCHOR)}, 0)))) as (pos, a))"),
    ("headline_words(title string)", "pos int, word string",
     f"select posexplode(filter(split({_NORM}, ' '), w -> w <> '')) as (pos, word)"),   # a generator takes no SQL function
)


def register(spark: SparkSession) -> list[str]:
    """Add the functions to a session for its life; gives their names. Registering twice replaces them.

    Null arguments give null, or no rows from a table function.
    """
    for head, result, body in SCALARS:
        spark.sql(f"create or replace temporary function {head} returns {result} return {body}")
    for head, columns, body in TABLES:
        spark.sql(f"create or replace temporary function {head} returns table ({columns}) return {body}")
    return [head.split("(")[0] for head, *_ in SCALARS + TABLES]
