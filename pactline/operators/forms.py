"""Headlines by form: what a parser reads from a headline is worked out once per distinct form and joined back.

The form of a text is the text with every word that no rule knows replaced by a mark of the same length and the same
capitals; the same word gets the same mark. Rules look at known words, capitals, lengths and equal words only, so they read
the same from the form, with marks where the names were. Texts whose words could be taken for marks, that hold a word in
several spellings, or more distinct names than there are marks, are their own form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, small_side

_LETTERS = "bcdfghjklmnprtvwxz"
_MARKS = len(_LETTERS) ** 2
# Words that a cut window of a text may shorten to a known one, or that a rule knows by their ending, stay as they are.
_STAY = ("deal|acqui|takeover|buy|merger|transaction|bid|offer|purchase|sale|up|private|ria|firm|practice|office|wealth|advis|aum|"
         "asset|business|team")
_STAY_ENDS = "(?:ing|to|for|with|worth|pays|at|combined|priced|valued)$"


def known_words(*sources) -> list[str]:
    """The words of at least five letters in texts, lists and mappings of them; 'word*' stands for a word with any ending."""
    texts: list[str] = []

    def collect(x) -> None:
        if isinstance(x, str):
            texts.append(x)
        elif isinstance(x, dict):
            collect([*x.keys(), *x.values()])
        elif isinstance(x, Iterable):
            for y in x:
                collect(y)

    collect(sources)
    found = {w for t in texts for w in re.findall(r"[a-z]+\*?", t.lower())}
    return sorted(w for w in found if len(w) >= 5 or w.endswith("*"))


_NAME = r"(?<![\p{L}\p{N}_])[A-Z][a-z]{4,}(?![\p{L}\p{N}_])"


class Reader(NamedTuple):
    """What is read from the texts of a column.

    `read(forms, column)` adds columns to the distinct forms, `restore(column)` gives each with the names of the text. `known` are the
    words that its rules know; with None the texts are read as they are, once per distinct text.
    """

    text: str
    known: list[str] | None
    read: Callable[[DataFrame, str], DataFrame]
    restore: Callable[[str], Column]


def with_form(df: DataFrame, text: str, known: list[str] | None, form: str = "_form", marks: str = "_marks") -> DataFrame:
    """Add `form` and `marks`, array<struct<name, mark>> of the replaced words."""
    if known is None:
        return df.withColumn(marks, F.array().cast("array<struct<name:string,mark:string>>")).withColumn(
            form, F.coalesce(F.col(text), F.lit("")))
    whole = ", ".join(f"'{w}'" for w in known if not w.endswith("*"))
    # one group behind the anchor, so that a word that fits nowhere is left after one step
    stay = "^(?:" + "|".join([_STAY, *(w[:-1] for w in known if w.endswith("*"))]) + ")|" + _STAY_ENDS
    t, n = f"`{text}`", len(_LETTERS)
    work = df.withColumn("_found", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_NAME), 0))
    work = work.withColumn("_names", F.expr(
        f"array_distinct(filter(_found, p -> NOT lower(p) IN ({whole}) AND NOT lower(p) RLIKE '{stay}'))"))
    # in any spelling, a name stands in the text only where it was found as a word
    alone = (f"forall(_names, p -> length({t}) - length(replace(lower({t}), lower(p), '')) = length(p) * size(filter(_found, f -> f = p)))")
    plain = f"size(_names) <= {_MARKS} AND NOT contains(lower({t}), 'zuz') AND {alone}"
    letter = lambda i: f"substring('{_LETTERS}', cast({i} AS int) + 1, 1)"
    made = f"""transform(CASE WHEN size(_names) = 0 OR {plain} THEN _names ELSE cast(array() AS array<string>) END, (p, i) -> named_struct(
        'name', p, 'mark', concat('Zuz', repeat('u', length(p) - 5), {letter(f'i div {n}')}, {letter(f'i % {n}')})))"""
    work = work.withColumn(marks, F.expr(made))
    marked = f"aggregate({marks}, {t}, (form, x) -> replace(form, x.name, x.mark))"
    out = F.expr(f"coalesce(CASE WHEN size({marks}) = 0 THEN {t} ELSE {marked} END, '')")
    return work.withColumn(form, out).drop("_found", "_names")


def restored(text: Column) -> Column:
    """A text read from a form, with the names in place of their marks."""
    back = F.aggregate("_marks", text, lambda named, x: F.replace(named, x["mark"], x["name"]))
    return F.when(F.contains(text, F.lit("Zuz")), back).otherwise(text)


def by_form(df: DataFrame, text: str, known: list[str] | None, read: Callable[[DataFrame, str], DataFrame],
            restore: Callable[[str], Column]) -> DataFrame:
    """Add the columns that `read(forms, column)` adds to the distinct forms of a text, `restore(column)` giving each with names.

    Rows whose form `read` drops are dropped.
    """
    return by_forms(df, [Reader(text, known, read, restore)])


def by_forms(df: DataFrame, readers: list[Reader]) -> DataFrame:
    """`by_form` for several texts of a frame, which is read once for the forms of all and once more for the result."""
    if df.isStreaming:
        for r in readers:
            df = r.read(df, r.text)
        return df
    work = df
    for i, r in enumerate(readers):
        work = with_form(work, r.text, r.known, f"_form{i}", f"_marks{i}")
    # the forms are stored first, or filters of `read` would be pushed below `distinct` to every row
    forms = checkpointed(work.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"_form{i}").alias("form")) for i in range(len(readers))])).alias("f")).select("f.*").distinct())
    for i, r in enumerate(readers):
        found = checkpointed(r.read(forms.where(F.col("i") == i).select(F.col("form").alias("_form")), "_form"))
        added = [c for c in found.columns if c != "_form"]
        # a key of its own: on the form the filters of `read`, which the stored frame still states, would be put to every row again
        keyed = small_side(found.select(F.concat("_form", F.lit("")).alias("_key"), *added))
        work = work.drop(*added).join(keyed, F.col(f"_form{i}") == F.col("_key")).withColumnRenamed(f"_marks{i}", "_marks")
        rest = [c for c in work.columns if c not in added and c not in ("_marks", "_key", f"_form{i}")]
        work = work.select(*rest, *[r.restore(c).alias(c) for c in added])
    return work
