"""Exact order statistics of whole columns, found by narrowing: no sort, no shuffle of rows, no written copy.

A first pass counts the values of each column by a key that keeps their order: sign, binary exponent and the
leading part of the fraction. Each cell comes back with its count and its least and greatest value, so
the cell that holds a wanted rank is known exactly. The next pass cuts that cell's range into equal
steps and counts again, and so on; a cell of a single value is an answer, a small one is collected. A pass
narrows the range about two-thousandfold, so even columns of any size and shape take a handful of
passes over one or few columns. All wanted ranks of all columns share every pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells per power of two in the first pass, steps of a range in the later ones.
_LEADING, _STEPS = 32, 2_048
#: Values of a cell that are looked at one by one.
FEW = 5_000

_Cell = tuple[str, float, float]  # column, least and greatest value


def _leading(v: Column) -> Column:
    """A whole number that never falls as the value rises; NaN is the greatest value."""
    size = F.floor(F.log2(F.abs(v)) * _LEADING) + 40_000
    ends = F.when(F.isnan(v), 1_000_000).when(v == F.lit(math.inf), 900_000).when(v == F.lit(-math.inf), -900_000).when(v == 0, 0)
    return ends.when(v > 0, size).otherwise(-size).cast("int")


def _step(v: Column, low: float, high: float) -> Column:
    return F.floor((v - F.lit(low)) / F.lit(high - low) * _STEPS).cast("int")


def _order(value: float) -> tuple:
    return (value != value, value)


def _find(cells: Sequence[tuple[int, float, float]], place: int) -> tuple[int, int, float, float]:
    """(values before the cell, its size, its least and greatest value) of the cell that holds a place."""
    before = 0
    for size, low, high in sorted(cells, key=lambda c: _order(c[1])):
        if place < before + size:
            return before, size, low, high
        before += size
    raise AssertionError("a place beyond the last value")


def _gather(rows: DataFrame) -> dict[int, list[tuple[int, float, float]]]:
    """Count, least and greatest value of every (i, cell)."""
    found: dict[int, list] = {}
    for r in rows.groupBy("i", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        found.setdefault(r["i"], []).append((r["n"], r["low"], r["high"]))
    return found


def _inside(df: DataFrame, cells: Sequence[_Cell], make) -> DataFrame:
    """(i, ...) for every value in one of the cells; ``make`` gives the other fields."""
    hits = []
    for i, (column, low, high) in enumerate(cells):
        v = F.col(column).cast("double")
        hits.append((v.between(F.lit(low), F.lit(high)), F.struct(F.lit(i).alias("i"), *make(v, low, high))))
    if len(hits) == 1:
        return df.filter(hits[0][0]).select(hits[0][1].alias("e")).select("e.*")
    some = hits[0][0]
    for hit, _ in hits[1:]:
        some = some | hit
    each = F.array_compact(F.array(*[F.when(hit, fields) for hit, fields in hits]))
    return df.filter(some).select(F.explode(each).alias("e")).select("e.*")


def at_ranks(df: DataFrame, wanted: dict[str, Sequence[float]], few: int = FEW) -> dict[str, list[tuple[float, float, float] | None]]:
    """For shares of every column: the values at the ranks around share x (n - 1), and the part between them.

    Ranks are over the non-null values; null for a column without values.
    """
    columns = list(wanted)
    if not columns:
        return {}
    values = [F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    long = df.select((F.explode(F.array(*values)) if len(values) > 1 else values[0]).alias("e")).select("e.*")
    first = _gather(long.filter("v is not null").withColumn("cell", _leading(F.col("v"))))
    sizes = {c: sum(x[0] for x in first.get(i, [])) for i, c in enumerate(columns)}
    at = {c: [(sizes[c] - 1) * share for share in wanted[c]] if sizes[c] else [] for c in columns}
    answer: dict[tuple[str, int], float] = {}
    left: dict[tuple[str, int], tuple[int, _Cell, int]] = {}  # (column, rank): values before its cell, the cell, its size

    def place(key: tuple[str, int], below: int, cells: Sequence[tuple[int, float, float]]) -> None:
        column, rank = key
        before, size, low, high = _find(cells, rank - below)
        if low == high or low != low:
            answer[key] = low
            left.pop(key, None)
        else:
            left[key] = (below + before, (column, low, high), size)

    for i, c in enumerate(columns):
        for x in at[c]:
            for rank in {math.floor(x), math.ceil(x)}:
                place((c, rank), 0, first[i])
    while large := list(dict.fromkeys(cell for _, cell, size in left.values() if size > few)):
        counted = _gather(_inside(df, large, lambda v, low, high: (_step(v, low, high).alias("cell"), v.alias("v"))))
        for key, (below, cell, _) in list(left.items()):
            if cell in large:
                place(key, below, counted[large.index(cell)])
    small = list(dict.fromkeys(cell for _, cell, _ in left.values()))
    if small:
        found: dict[int, list[float]] = {}
        for r in _inside(df, small, lambda v, low, high: (v.alias("v"),)).collect():  # at most ``few`` values a cell
            found.setdefault(r["i"], []).append(r["v"])
        for key, (below, cell, _) in left.items():
            answer[key] = sorted(found[small.index(cell)])[key[1] - below]
    return {c: [(answer[c, math.floor(x)], answer[c, math.ceil(x)], x - math.floor(x)) for x in at[c]] or [None] * len(wanted[c]) for c in columns}


def quantiles_of(df: DataFrame, wanted: dict[str, Sequence[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation; null for a column without values."""

    def between(low: float, high: float, share: float) -> float:
        return low if low == high else low + (high - low) * share

    return {c: [v and between(*v) for v in found] for c, found in at_ranks(df, wanted, few).items()}
