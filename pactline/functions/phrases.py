"""Plain phrases to patterns.

A phrase is ordinary text. A space stands for white space or one hyphen, '#' for a number, '$' for a dollar figure, '_' for any
one word, and a final '*' for any ending. Lists of phrases are kept as comma-separated text, in natural order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

MONEY = r"\$[\d.,]+(?:\s*[a-zA-Z]{1,8})?\+?"
_SIGNS = {"#": r"\d[\d.,]*", "$": MONEY, "_": r"\w+"}


def listed(text: str) -> list[str]:
    """Phrases of a comma-separated text."""
    return [p.strip() for p in " ".join(text.split()).split(",") if p.strip()]


def _word(w: str) -> str:
    if w in _SIGNS:
        return _SIGNS[w]
    return re.escape(w[:-1]) + r"\w*" if w.endswith("*") else re.escape(w)


def one_phrase(text: str) -> str:
    """Pattern of one of the listed phrases, without word edges."""
    return "(?:" + "|".join(r"(?:\s+|-)".join(map(_word, p.split())) for p in listed(text)) + ")"


def anywhere(text: str) -> str:
    """Pattern of one of the listed phrases on word edges."""
    return rf"(?<!\w){one_phrase(text)}(?!\w)"


def in_order(*lists: str, gap: int | None = None) -> str:
    """One phrase of each list after another: directly, or within `gap` characters."""
    between = r"\s+" if gap is None else rf"\b.{{0,{gap}}}\b"
    return r"(?<!\w)" + between.join(one_phrase(x) for x in lists) + r"(?!\w)"


def says(text: Column, *patterns: str) -> Column:
    """Whether any of the patterns stands in the text, in any case."""
    return text.rlike("(?i)" + "|".join(patterns))
