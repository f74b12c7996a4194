"""Small helpers over array columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.transform(F.array(value), body)[0]


def at(items: Column, i: Column) -> Column:
    """Zero-based element, null when out of range."""
    return F.get(items, i)


def positions(items: Column) -> Column:
    """0..n-1 for an array, empty for an empty one."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(
        F.array().cast("array<int>"))


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def one_of(col: Column, words) -> Column:
    """Membership in a fixed word list as a single anchored pattern (one plan node instead of one per word)."""
    return col.rlike("^(?:" + "|".join(re.escape(w) for w in words) + ")$")
