"""Map rows on a space-filling curve: a box becomes a few key ranges, which parquet statistics prune."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
EXTENT = 1024.0       # map units a side; positions outside lie in the border cells
MAX_RANGES = 64       # cells that a box is split into at most, before neighbours are joined
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _cell(v: Column) -> Column:
    top = float((1 << BITS) - 1)
    return F.floor(F.least(F.greatest(v * ((1 << BITS) / EXTENT), F.lit(0.0)), F.lit(top))).cast("bigint")


def _spread(v: Column) -> Column:
    """The bits of a cell number, one place apart."""
    return reduce(lambda out, s: out.bitwiseOR(F.shiftleft(out, s[0])).bitwiseAND(F.lit(s[1]).cast("bigint")), _SPREAD, v)


def z_key(x: Column, y: Column) -> Column:
    """Position on the Z curve. Missing positions get some key and are never inside a box."""
    return _spread(_cell(x)).bitwiseOR(F.shiftleft(_spread(_cell(y)), 1))


def z_ranges(x0: float, y0: float, x1: float, y1: float, limit: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Key ranges that cover a box: squares of the curve are quartered breadth first while there are few of them."""
    top = (1 << BITS) - 1
    cell = lambda v: int(min(max(v * ((1 << BITS) / EXTENT), 0), top))
    left, low, right, high = cell(x0), cell(y0), cell(x1), cell(y1)
    if x0 > x1 or y0 > y1:
        return []
    whole: list[tuple[int, int]] = []
    cut = [(0, 0, 0, 1 << BITS)]          # first key, corner, side
    while cut and len(whole) + 4 * len(cut) <= limit:
        parts = []
        for key, cx, cy, side in cut:
            half = side // 2
            for i in range(4):
                px, py = cx + half * (i & 1), cy + half * (i >> 1)
                if px > right or py > high or px + half <= left or py + half <= low:
                    continue
                square = (key + i * half * half, px, py, half)
                inside = left <= px and px + half - 1 <= right and low <= py and py + half - 1 <= high
                (whole.append((square[0], square[0] + half * half - 1)) if inside or half == 1 else parts.append(square))
        cut = parts
    spans = sorted(whole + [(k, k + s * s - 1) for k, _, _, s in cut])
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def write_map(firms: DataFrame, path: str) -> None:
    """Store rows with columns x, y in curve order, so that each file and row group holds a compact piece of the map."""
    keyed = firms.withColumn("_z", z_key(F.col("x"), F.col("y")))
    keyed.repartitionByRange("_z", F.xxhash64("x", "y")).sortWithinPartitions("_z").write.mode("overwrite").parquet(path)


def box(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Stored rows inside a box, borders included, as `geo.viewport` has them; key ranges reach the scan."""
    stored = spark.read.parquet(path)
    ranges = z_ranges(x0, y0, x1, y1)
    near = reduce(lambda a, b: a | b, [F.col("_z").between(a, b) for a, b in ranges], F.lit(False))
    return stored.where(near & F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).drop("_z")
