"""Dollar figures in text: spans, the first figure, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit spellings and their scale
UNIT_SCALE = {
    "trillion": 1e12, "tn": 1e12, "t": 1e12,
    "billion": 1e9, "bln": 1e9, "bn": 1e9, "b": 1e9,
    "million": 1e6, "mln": 1e6, "mm": 1e6, "mn": 1e6, "m": 1e6,
    "thousand": 1e3, "k": 1e3,
}
_UNITS = "|".join(sorted(UNIT_SCALE, key=lambda u: (-len(u), u)))
FIGURE = rf"(?i)\$\s?(?:\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s?-?\s?(?:{_UNITS})(?![a-z]))?"


def figure_value(matched: Column) -> Column:
    """'$1.2bn' -> 1.2e9. The argument is text that matched FIGURE."""
    number = F.regexp_replace(F.regexp_extract(matched, r"[\d.,]+", 0), ",", "").cast("double")
    unit = F.lower(F.regexp_extract(matched, r"([A-Za-z]+)$", 1))
    scale = F.lit(1.0)
    for factor in sorted(set(UNIT_SCALE.values())):
        names = [u for u, f in UNIT_SCALE.items() if f == factor]
        scale = F.when(unit.isin(*names), F.lit(factor)).otherwise(scale)
    return number * scale


def figures(text: Column) -> Column:
    """array<struct<start, end, value>> of every dollar figure, offsets zero-based."""
    found = F.regexp_extract_all(text, F.lit(FIGURE), 0)
    # lengths of the text between figures; a running sum over both gives the offsets in one pass
    gaps = F.transform(F.split(text, FIGURE, -1), F.length)
    empty = F.array().cast("array<struct<start:int,end:int,value:double>>")

    def step(acc: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + x["gap"]
        span = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), figure_value(x["m"]).alias("value"))
        return F.array_append(acc, span)

    pieces = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("gap")), lambda x: x["m"].isNotNull())
    return F.when(F.instr(text, "$") > 0, F.aggregate(pieces, empty, step)).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:double>>"))


def first_figure(text: Column) -> Column:
    hit = F.regexp_extract(text, FIGURE, 0)
    return F.when(hit != "", figure_value(hit))


def round_to(value: Column, step: float) -> Column:
    """Half-even rounding to a power of ten."""
    return F.bround(value / step) * F.lit(step)


def fixed(value: Column, decimals: int) -> Column:
    """Non-negative number below 2^53 with the given decimals, rounded half-even on its exact binary value.

    (Formatting and rounding functions work on the shortest decimal form, so 1.275 would round up although the
    double lies below the tie.)
    """
    ten = 10 ** decimals
    whole = F.floor(value)
    part = ((value - whole) * F.lit(float(2 ** 52))).cast("bigint") * ten
    up, rest = F.shiftright(part, 52), part.bitwiseAND(2 ** 52 - 1)
    up = F.when((rest > 2 ** 51) | ((rest == 2 ** 51) & ((whole * ten + up) % 2 == 1)), up + 1).otherwise(up)
    whole, up = F.when(up >= ten, whole + 1).otherwise(whole), F.when(up >= ten, up - ten).otherwise(up)
    text = whole.cast("string")
    return F.concat(text, F.lit("."), F.lpad(up.cast("string"), decimals, "0")) if decimals else text


def plain_number(value: Column, decimals: int) -> Column:
    """`fixed` without trailing zeros."""
    text = fixed(value, decimals)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "") if decimals else text


def _trimmed(value: Column) -> Column:
    return plain_number(value, 2)


def money_label(value: Column) -> Column:
    """1.2e9 -> '$1.2B'; null for null or zero."""
    return F.when(value.isNull() | (value == 0), F.lit(None).cast("string")).when(
        value >= 1e12, F.concat(F.lit("$"), _trimmed(value / 1e12), F.lit("T"))).when(
        value >= 1e9, F.concat(F.lit("$"), _trimmed(value / 1e9), F.lit("B"))).otherwise(
        F.concat(F.lit("$"), F.bround(value / 1e6).cast("bigint").cast("string"), F.lit("M")))


def aum_label(value: Column, source: Column, as_of: Column) -> Column:
    label = money_label(value)
    return F.when(label.isNull(), label).when(
        source == "sec", F.concat(label, F.lit(" SEC-reported AUM (as of "), as_of, F.lit(")"))).otherwise(
        F.concat(label, F.lit(" AUM (from headline)")))
