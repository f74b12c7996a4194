"""Industry tags from phrase rules, in rule order, most specific source first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import DEFAULT_INDUSTRY, INDUSTRIES
from .forms import Reader, by_forms, known_words


def _pattern(phrases: tuple[str, ...]) -> str:
    """Phrases on word boundaries; '&' counts as part of a word. 're:' marks a raw pattern."""
    raw = [f"(?:{p[3:]})" for p in phrases if p.startswith("re:")]
    plain = [r"\s+".join(re.escape(w) for w in p.split()) for p in phrases if not p.startswith("re:")]
    parts = raw
    if plain:  # one boundary test for the whole list, so most positions fail at once
        edge = r"[\p{L}\p{N}_&]"
        parts = [rf"(?<!{edge})(?:{'|'.join(plain)})(?!{edge})", *raw]
    return "(?i)" + "|".join(parts)


def hits(text: Column, rules=INDUSTRIES) -> Column:
    """Names of the rules that hit one text, in rule order."""
    found = []
    for name, yes, no in rules:
        ok = text.rlike(_pattern(yes))
        if no:
            ok = ok & ~text.rlike(_pattern(no))
        found.append(F.when(ok, F.lit(name)))
    return F.array_compact(F.array(*found))


def in_rule_order(names: Column, rules=INDUSTRIES) -> Column:
    """Keep known names once, ordered by rule; the default alone when nothing is left."""
    order = F.array(*[F.lit(r[0]) for r in rules])
    kept = F.filter(order, lambda n: F.array_contains(names, n))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(DEFAULT_INDUSTRY)))


def words(rules=INDUSTRIES) -> list[str] | None:
    """The words that the rules know; None when a raw pattern may know others."""
    phrases = [p for _, yes, no in rules for p in (*yes, *no)]
    return None if any(p.startswith("re:") for p in phrases) else known_words(phrases)


def reader(text: str, found: str, rules=INDUSTRIES) -> Reader:
    """Reads the rules that hit a text into the column `found`."""
    return Reader(text, words(rules), lambda forms, t: forms.withColumn(found, hits(F.coalesce(F.col(t), F.lit("")), rules)), F.col)


def decided(df: DataFrame, hint: str | None = None, rules=INDUSTRIES) -> DataFrame:
    """Add `industries` and `category` from `_head` and `_body`, the hits of headline and description."""
    found = F.when(F.size("_head") > 0, F.col("_head")).otherwise(F.col("_body"))
    if hint is not None:
        found = F.array_compact(F.array_append(found, F.col(hint)))
    out = df.withColumn("industries", in_rule_order(found, rules)).drop("_head", "_body")
    return out.withColumn("category", F.get("industries", F.lit(0)))


def tag(df: DataFrame, title: str = "title", description: str = "description", hint: str | None = None,
        rules=INDUSTRIES) -> DataFrame:
    """Add `industries` and `category`. The description decides only when the headline hits nothing."""
    return decided(by_forms(df, [reader(title, "_head", rules), reader(description, "_body", rules)]), hint, rules)


def union_of(lists: Column, rules=INDUSTRIES) -> Column:
    """Union of collected tag lists in rule order; the default only when nothing else is left."""
    return in_rule_order(F.array_distinct(F.flatten(lists)), rules)


def counts(df: DataFrame, industries: str = "industries") -> DataFrame:
    return df.select(F.explode(industries).alias("industry")).groupBy("industry").agg(
        F.count(F.lit(1)).alias("n"))
