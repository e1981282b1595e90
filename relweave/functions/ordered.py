"""Ordered functions that stay distributed: prefix scans, row index and lag.

A Spark window without a partition key, or with one dominant key, puts all those rows into
one task. Here the rows to be ordered are cut into blocks first:

1. bounds of the blocks come from a small sample of the sort key (the full key, tie-break
   included, so that a hot timestamp is cut as well);
2. a row finds its block by binary search over the bounds, a pure expression, so the block
   of a row never changes when a task is recomputed;
3. each block runs an ordinary window, while one partial aggregate per block gives the value
   carried in from the blocks before it.

With a key, only keys larger than ``Scale.block_rows`` are cut; the rest use a plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.session import DEFAULT_SCALE, Scale

BLOCK = "__block"
_HOT = "__hot"
_KEY = "__key"


# ---------------------------------------------------------------------------- hot keys


@dataclass
class KeySizes:
    """What one counting pass tells about the groups of a key."""

    rows: int
    null_rows: int
    hot: DataFrame | None
    hot_keys: int
    hot_rows: int
    counted: DataFrame | None = None  # the hot keys with their row counts as ``__n``


def key_sizes(df: DataFrame, key: Sequence[str], scale: Scale = DEFAULT_SCALE) -> KeySizes:
    """List the keys too large for one task.

    A table no larger than a block has none, which one narrow count shows; otherwise rows are
    counted per key. The hot list is small by construction: each of its keys holds more than
    ``max(block_rows, rows / max_hot_keys)`` rows.
    """
    total, nulls = df.agg(F.count(F.lit(1)), F.count_if(_any_null(key))).first()
    if total <= scale.block_rows:
        return KeySizes(total, nulls, None, 0, 0)
    n = F.col("__n")
    counts = df.filter(~_any_null(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    limit = max(scale.block_rows, total // scale.max_hot_keys)
    rows = counts.filter(n > limit).collect()
    if not rows:
        return KeySizes(total, nulls, None, 0, 0)
    schema = T.StructType([*[df.schema[k] for k in key], T.StructField("__n", T.LongType())])
    counted = df.sparkSession.createDataFrame([(*[r[k] for k in key], r["__n"]) for r in rows], schema)
    return KeySizes(total, nulls, counted.drop("__n"), len(rows), sum(r["__n"] for r in rows), counted)


def _any_null(key: Sequence[str]) -> Column:
    cond = F.lit(False)
    for k in key:
        cond = cond | F.col(k).isNull()
    return cond


# ------------------------------------------------------------------------------ blocks


def _comparable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name))
    return F.col(name)


def _sort_struct(df: DataFrame, order: Sequence[str]) -> Column:
    return F.struct(*[_comparable(df, c).alias(f"k{i}") for i, c in enumerate(order)])


def _block_count(rows: int, scale: Scale, parallelism: int) -> int:
    by_size = math.ceil(rows / scale.block_rows)
    by_cores = min(parallelism, rows // 20_000)
    return int(min(max(by_size, by_cores, 1), scale.max_blocks))


def with_block(
    df: DataFrame,
    order: Sequence[str],
    rows: int,
    n_blocks: int,
    scale: Scale = DEFAULT_SCALE,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add each row's block number along ``order``; bounds come from ``source`` (``df`` itself).

    The binary search is a chain of projections, one per step, which Spark compiles into one
    stage; a lambda over the bounds would be interpreted for every row.
    """
    found = df.withColumn(BLOCK, F.lit(0))
    if n_blocks <= 1:
        return found
    bounds, kind = _sample_bounds(df if source is None else source, order, rows, n_blocks, scale)
    if not bounds:
        return found
    array = F.from_json(F.lit("[" + ",".join(bounds) + "]"), T.ArrayType(kind))
    found = found.withColumn(_KEY, _sort_struct(df, order))
    at = F.col(BLOCK)
    for step in (1 << i for i in reversed(range(len(bounds).bit_length()))):
        reached = F.get(array, at + (step - 1)) <= F.col(_KEY)
        found = found.withColumn(BLOCK, F.when(reached, at + step).otherwise(at))
    return found.drop(_KEY)


def _sample_bounds(df, order, rows, n_blocks, scale) -> tuple[list[str], T.StructType]:
    keys = df.select(_sort_struct(df, order).alias("k"))
    wanted = n_blocks * scale.oversample
    if rows > wanted:
        grid = 1 << 30
        keep = max(1, math.ceil(wanted / rows * grid))
        keys = keys.filter(F.pmod(F.xxhash64("k"), F.lit(grid)) < keep)
    sample = [r[0] for r in keys.sort("k").select(F.to_json("k")).collect()]
    if not sample:
        return [], keys.schema["k"].dataType
    picks = sorted({len(sample) * i // n_blocks for i in range(1, n_blocks)})
    return list(dict.fromkeys(sample[p] for p in picks)), keys.schema["k"].dataType


@dataclass
class _Blocked:
    df: DataFrame
    keys: list[str]
    cut: bool  # whether any rows are spread over several blocks
    bounded_carry: bool
    rest: DataFrame | None  # rows whose key is null


def _blocked(df: DataFrame, order: Sequence[str], key: Sequence[str], scale: Scale) -> _Blocked:
    key = list(key)
    if not key:
        rows = df.count()
        n = _block_count(rows, scale, df.sparkSession.sparkContext.defaultParallelism)
        return _Blocked(with_block(df, order, rows, n, scale), [], n > 1, True, None)
    sizes = key_sizes(df, key, scale)
    rest = df.filter(_any_null(key)) if sizes.null_rows else None
    body = df.filter(~_any_null(key)) if sizes.null_rows else df
    if sizes.hot is None:
        return _Blocked(body.withColumn(BLOCK, F.lit(0)), key, False, True, rest)
    marked = body.join(F.broadcast(sizes.hot.withColumn(_HOT, F.lit(True))), key, "left")
    hot_rows = marked.filter(_HOT)
    n = max(2, _block_count(sizes.hot_rows, scale, 1))
    marked = with_block(marked, order, sizes.hot_rows, n, scale, hot_rows)
    marked = marked.withColumn(BLOCK, F.when(F.col(_HOT), F.col(BLOCK) + 1).otherwise(0)).drop(_HOT)
    return _Blocked(marked, key, True, sizes.hot_keys * n <= scale.broadcast_rows, rest)


# ------------------------------------------------------------------------- prefix scan


@dataclass(frozen=True)
class Scan:
    """One running value: what a block computes, hands on, and how both are merged.

    ``kind``: sum, mean, max, min, prod, count, index or last. ``inclusive`` says whether the
    current row takes part. ``skip_null`` emits null where the input is null (the running
    value itself always ignores nulls).
    """

    kind: str
    column: Column | None = None
    inclusive: bool = True
    skip_null: bool = True


_LOCAL: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "prod": F.product,
    "count": F.count,
    "last": lambda c: F.last(c, ignorenulls=True),
}
_CARRY: dict[str, Callable[[Column], Column]] = {**_LOCAL, "count": F.sum}
_MERGE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "prod": lambda a, b: F.coalesce(a * b, a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def _parts(spec: Scan) -> list[str]:
    """The elementary running values a scan is made of."""
    return {"mean": ["sum", "index"], "index": ["index"]}.get(spec.kind, [spec.kind])


def _value(spec: Scan, part: str) -> tuple:
    return part, spec.inclusive, None if part == "index" else id(spec.column)


def prefix_scan(
    df: DataFrame,
    order: Sequence[str],
    scans: dict[str, Scan],
    key: Sequence[str] = (),
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Add one running column per entry of ``scans``, along ``order`` and within ``key``.

    ``order`` must be unique within the key (end it with the row id). Rows with a null key
    come back with null results. A running sum that several scans of one Column object need is computed once.
    """
    b = _blocked(df, order, key, scale)
    part = [*b.keys, BLOCK]
    ordered = Window.partitionBy(*part).orderBy(*order)
    local, totals, carries = [], [], []
    names: dict[tuple, str] = {}  # of the elementary values; scans of one Column object share them
    for name, spec in scans.items():
        end = 0 if spec.inclusive else -1
        frame = ordered.rowsBetween(Window.unboundedPreceding, end)
        for p in _parts(spec):
            if _value(spec, p) in names:
                continue
            names[_value(spec, p)] = f"{name}_{p}"
            fn = "count" if p == "index" else p
            col = F.lit(1) if p == "index" else spec.column
            local.append(_LOCAL[fn](col).over(frame).alias(f"__l_{name}_{p}"))
            if fn == "last":
                total = F.max_by(col, F.when(col.isNotNull(), F.struct(*order)))
            else:
                total = _LOCAL[fn](col)
            totals.append(total.alias(f"__t_{name}_{p}"))
            carries.append((f"__c_{name}_{p}", fn, f"__t_{name}_{p}"))
    rows = b.df.select("*", *local)
    if b.cut:
        source = b.df if not b.keys else b.df.filter(F.col(BLOCK) > 0)
        per_block = source.groupBy(*part).agg(*totals)
        before = (
            Window.partitionBy(*(b.keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = per_block.select(*part, *[_CARRY[fn](F.col(t)).over(before).alias(c) for c, fn, t in carries])
        rows = rows.join(F.broadcast(carry) if b.bounded_carry else carry, part, "left")
    out = []
    for name, spec in scans.items():
        merged = {}
        for p in _parts(spec):
            fn = "count" if p == "index" else p
            at = names[_value(spec, p)]
            here = F.col(f"__l_{at}")
            merged[p] = _MERGE[fn](F.col(f"__c_{at}"), here) if b.cut else here
        value = merged["sum"] / merged["index"] if spec.kind == "mean" else merged[_parts(spec)[0]]
        if spec.skip_null and spec.inclusive and spec.kind not in ("index", "last"):
            value = F.when(spec.column.isNotNull(), value)
        out.append(value.alias(name))
    result = rows.select(*df.columns, *out)
    if b.rest is not None:
        blank = [F.lit(None).cast(result.schema[n].dataType).alias(n) for n in scans]
        result = result.unionByName(b.rest.select(*df.columns, *blank))
    return result


def row_index(
    df: DataFrame,
    order: Sequence[str],
    name: str = "row_index",
    key: Sequence[str] = (),
    start: int = 0,
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Dense position of each row along ``order`` (within ``key``), counted from ``start``."""
    out = prefix_scan(df, order, {name: Scan("index")}, key, scale)
    return out.withColumn(name, F.col(name) - 1 + start)


def lag(
    df: DataFrame,
    order: Sequence[str],
    columns: dict[str, str],
    key: Sequence[str] = (),
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Value of the previous row: ``columns`` maps the new name to the source column."""
    tmp = {f"__p_{n}": Scan("last", F.struct(F.col(c).alias("v")), inclusive=False) for n, c in columns.items()}
    out = prefix_scan(df, order, tmp, key, scale)
    return out.select(*df.columns, *[F.col(f"__p_{n}.v").alias(n) for n in columns])
