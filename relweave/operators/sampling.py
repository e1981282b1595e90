"""Repeatable sampling, balancing, splitting and folds.

Every draw is a hash of (seed, row id), so it does not depend on partitioning. Exact sample
sizes need no sort: histograms over hash prefixes find the hash of the n-th smallest row,
and the sample is the filter "hash not above it", which moves no data. Rows with the same id share a
draw; where a sample ends among them, their contents decide (``choose``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.aggregates import class_counts
from relweave.functions.ordered import row_index
from relweave.schema import LABEL, ROW_ID
from relweave.session import DEFAULT_SCALE, Scale

# Default sizes and shares of the sampling steps.
SAMPLE_ROWS = 5_000
TRAIN_ROWS = 20_000
MAX_ROWS = 4_000_000
DOWN_SHARE = 0.5
MAJORITY_SHARE_SKEWED = 0.16
MAJORITY_SHARE = 0.3
SKEWED_RATIO = 6
UNDER_SAMPLE_RATIO = 3
VALIDATION_SHARE = 0.2
FOLDS = 5
HOLDOUT_ROWS = 20_000
HOLDOUT_SHARE = 0.1

_DIGITS = 3  # hex digits of the hash resolved per histogram pass
_RUN = 10_000  # copies of a row made from one array
_FEW = 20_000  # rows small enough to look at one by one
_BITS = 12  # bits of a number resolved per histogram pass


def draw(seed: int | str, row_id: str | Column = ROW_ID) -> Column:
    """The draw of a row: a hex string, uniform over rows for any seed; a null id draws like an empty one."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(rid.cast("string"), F.lit(""))))


def uniform(seed: int | str, row_id: str | Column = ROW_ID) -> Column:
    """The draw as a number in (0, 1), from its first 12 hex digits."""
    whole = F.conv(F.substring(draw(seed, row_id), 1, 12), 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(16**12))


def nth(df: DataFrame, key: Column, n: int) -> tuple[str, int, int] | None:
    """The n-th smallest (1-based) of a column of hex strings, null if there are fewer rows than ``n``.

    Returns the string, how many of the rows that share it are among the n smallest, and how many share
    it. Each pass counts the next hex digits within the prefix found so far: 4096 counters, from which
    the prefix that holds the n-th row follows. The pass over all rows only counts: least and greatest
    strings would have them sorted.
    """
    rows = df.select(key.alias("h"))
    prefix, left = "", n
    while True:
        within = rows.filter(F.col("h").startswith(prefix)) if prefix else rows
        cells = within.groupBy(F.substring("h", len(prefix) + 1, _DIGITS).alias("c"))
        ends = (F.min("h"), F.max("h")) if prefix else (F.lit(""), F.lit(None))
        cells = cells.agg(F.count(F.lit(1)), *ends).collect()
        for cell, size, low, high in sorted(cells, key=lambda c: c[0]):
            if left <= size:
                prefix += cell
                break
            left -= size
        else:
            return None
        if low == high:
            return low, left, size  # many rows share one string
        if size <= _FEW:
            found = sorted(r["h"] for r in rows.filter(F.col("h").startswith(prefix)).collect())
            value = found[left - 1]
            return value, left - found.index(value), found.count(value)


@dataclass(frozen=True)
class Cut:
    """The last of some number of rows in the order of (draw, contents).

    ``contents`` is null where the rows up to the draw are all taken. Rows equal in both are equal in every
    column, so it only matters how many of them are taken."""

    draw: str
    contents: str | None = None
    taken: int = 1
    equal: int = 1


def contents(df: DataFrame) -> Column:
    """A hex string of all columns of a row: rows that differ have other strings, whatever their ids."""
    cells = [F.col(f"`{f.name}`") for f in df.schema.fields]
    plain = [c for c, f in zip(cells, df.schema.fields, strict=True) if not isinstance(f.dataType, T.MapType)]
    number = F.xxhash64(*plain, *[c.isNull() for c in cells])
    text = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    return F.concat(F.lpad(F.lower(F.hex(number)), 16, "0"), F.md5(text))


def find_cut(df: DataFrame, hashed: Column, n: int) -> Cut | None:
    """Where the ``n`` smallest rows end; null if that is all of them."""
    found = nth(df, hashed, n)
    if found is None:
        return None
    value, taken, tied = found
    if taken == tied:
        return Cut(value)
    return Cut(value, *nth(df.filter(hashed == value), contents(df), taken))


def choose(df: DataFrame, hashed: Column, sizes: Sequence[tuple[Column, int]], name: str) -> DataFrame:
    """Mark exactly ``n`` rows of every disjoint part ``(condition, n)``: those with the smallest hashes.

    Rows that share a hash (repeated ids, null ids) are taken in the order of their contents, and of rows
    that are equal in every column the wanted number is marked. So the sizes are exact, the marked rows are
    the same under any partitioning, and they and the others make up the table. Where no equal
    rows have to be told apart, the mark is an expression over the row.
    """
    marked, apart, shared = F.lit(False), F.lit(False), []
    for part, n in sizes:
        part = F.coalesce(part, F.lit(False))
        if n <= 0:
            continue
        cut = find_cut(df.filter(part), hashed, n)
        if cut is None:
            marked = marked | part
        elif cut.contents is None:
            marked = marked | (part & (hashed <= cut.draw))
        else:
            level = contents(df)
            marked = marked | (part & ((hashed < cut.draw) | ((hashed == cut.draw) & (level <= cut.contents))))
            if cut.taken < cut.equal:
                same = part & (hashed == cut.draw) & (level == cut.contents)
                apart = apart | same
                shared.append((same, cut))
    if not shared:
        return df.withColumn(name, marked)
    out = df.filter(~apart).withColumn(name, marked)
    for same, cut in shared:
        copies = _repeat(df.filter(same).limit(1), F.lit(cut.equal).cast("bigint"), "__copy")
        out = out.unionByName(copies.withColumn(name, F.col("__copy") < cut.taken).drop("__copy"))
    return out


def smallest(df: DataFrame, hashed: Column, n: int) -> DataFrame:
    """Exactly the ``n`` rows with the smallest hashes (all rows if there are fewer)."""
    return choose(df, hashed, [(F.lit(True), n)], "__in").filter("__in").drop("__in")


# --------------------------------------------------------------------------- samples


def simple_sample(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 0, row_id: str = ROW_ID) -> DataFrame:
    """Exactly n random rows, or the whole table if it has no more."""
    return smallest(df, draw(seed, row_id), n)


def cap_rows(df: DataFrame, n: int = MAX_ROWS, seed: int = 0, row_id: str = ROW_ID) -> DataFrame:
    """Bound the rows that a model is fitted on; rows to be scored are never cut."""
    return simple_sample(df, n, seed, row_id)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, weight): each class weighs as much as the other class has rows."""
    sizes = class_counts(df, label)
    total = sum(sizes.values())
    rows = [(k, float(total - v)) for k, v in sizes.items()]
    return df.sparkSession.createDataFrame(rows, f"{label} {df.schema[label].dataType.simpleString()}, weight double")


def with_class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Attach the class weight (a table of one row per class) to every row."""
    return df.join(F.broadcast(class_weights(df, label)), label, "left").select(*df.columns, "weight")


def weighted_sample(
    df: DataFrame, n: int, weight: str = "weight", seed: int = 0, row_id: str = ROW_ID
) -> DataFrame:
    """n rows without replacement, each drawn in proportion to its weight.

    The n smallest of -ln(u) / weight. Its logarithm is written as fixed-width hex, which
    sorts like the number, so that the sample is found like any other.
    """
    rows = df.filter(F.col(weight) > 0)
    level = F.log(-F.log(uniform(seed, row_id))) - F.log(F.col(weight))
    scaled = F.lpad(F.lower(F.hex(F.floor((level + F.lit(200.0)) * F.lit(1e15)).cast("bigint"))), 16, "0")
    return smallest(rows, F.concat(scaled, draw(seed, row_id)), n)


def balanced_sample(df: DataFrame, n: int, label: str = LABEL, seed: int = 0, row_id: str = ROW_ID) -> DataFrame:
    """n rows in which both classes are equally likely, whatever their sizes."""
    return weighted_sample(with_class_weights(df, label), n, "weight", seed, row_id).drop("weight")


def per_class_sample(
    df: DataFrame, sizes: dict, label: str = LABEL, seed: int = 0, row_id: str = ROW_ID
) -> DataFrame:
    """Exactly ``sizes[c]`` random rows of each class c (all of a smaller class)."""
    parts = [(F.col(label).eqNullSafe(c), n) for c, n in sizes.items()]
    return choose(df, draw(seed, row_id), parts, "__in").filter("__in").drop("__in")


def stratified_sample(
    df: DataFrame, n: int = SAMPLE_ROWS, label: str = LABEL, seed: int = 0, row_id: str = ROW_ID
) -> DataFrame:
    """Exactly n rows that keep the class shares; the positives are rounded up. Rows without a label take no part."""
    sizes = class_counts(df, label)
    total = sizes.get(0, 0) + sizes.get(1, 0)
    if total <= n:
        return df.filter(F.col(label).isNotNull())
    ones = -(-sizes.get(1, 0) * n // total)
    return per_class_sample(df, {1: ones, 0: n - ones}, label, seed, row_id)


def down_sample(
    df: DataFrame, share: float = DOWN_SHARE, label: str = LABEL, seed: int = 0, row_id: str = ROW_ID
) -> DataFrame:
    """The same share of every class."""
    sizes = {c: int(n * share) for c, n in class_counts(df, label).items()}
    return per_class_sample(df, sizes, label, seed, row_id)


def _minor_major(df: DataFrame, label: str) -> tuple:
    sizes = class_counts(df, label)
    zeros, ones = sizes.get(0, 0), sizes.get(1, 0)
    return ((0, zeros), (1, ones)) if zeros < ones else ((1, ones), (0, zeros))


def balance_down(df: DataFrame, label: str = LABEL, seed: int = 0, row_id: str = ROW_ID) -> DataFrame:
    """All of the minority and a fixed share of the majority."""
    (minor, few), (major, many) = _minor_major(df, label)
    share = MAJORITY_SHARE_SKEWED if many > SKEWED_RATIO * few else MAJORITY_SHARE
    return per_class_sample(df, {minor: few, major: int(share * many)}, label, seed, row_id)


def balance_up(
    df: DataFrame, label: str = LABEL, seed: int = 0, row_id: str = ROW_ID, copy: str = "copy"
) -> DataFrame:
    """Repeat the minority up to the majority size, then keep half of the original row count.

    Copies are numbered in ``copy``. Every minority row is repeated alike; the rows that get
    one copy more are those with the smallest draws.
    """
    (minor, few), (major, many) = _minor_major(df, label)
    if not few:
        return df.withColumn(copy, F.lit(0))
    whole, extra = divmod(many, few)
    minority = choose(df.filter(F.col(label) == minor), draw(f"{seed}|up", row_id), [(F.lit(True), extra)], "__more")
    copies = F.lit(whole).cast("bigint") + F.col("__more").cast("int")
    repeated = _repeat(minority, copies, copy).drop("__more")
    both = df.filter(F.col(label) == major).withColumn(copy, F.lit(0)).unionByName(repeated)
    pick = draw(f"{seed}|half", F.concat_ws("-", F.col(row_id).cast("string"), F.col(copy).cast("string")))
    return smallest(both, pick, int((few + many) * 0.5))


def _repeat(df: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0, in runs short enough for one array each."""
    runs = F.explode(F.sequence(F.lit(0), F.floor((times - 1) / F.lit(_RUN))))
    started = df.withColumns({"__times": times, "__run": runs})
    first = F.col("__run") * _RUN
    last = F.least(first + F.lit(_RUN), F.col("__times")) - 1
    return started.withColumn(name, F.explode(F.sequence(first, last))).drop("__times", "__run")


def fresh_negatives(
    df: DataFrame,
    model: int,
    models: int,
    label: str = LABEL,
    ratio: int = UNDER_SAMPLE_RATIO,
    seed: int = 0,
    row_id: str = ROW_ID,
) -> DataFrame:
    """Training rows of one ensemble member: every positive and its own slice of negatives.

    Below the class ratio the table is used whole; above it the negatives are dealt into
    slices of ``ratio`` times the positives, and members take the slices in turn.
    """
    sizes = class_counts(df, label)
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or zeros <= ratio * ones:
        return df
    slices = math.ceil(zeros / (ratio * ones))
    mine = F.floor(uniform(seed, row_id) * slices) == (model % models) % slices
    return df.filter((F.col(label) == 1) | mine)


def class_union(*samples: DataFrame) -> DataFrame:
    """Stack class samples of the same columns."""
    out = samples[0]
    for s in samples[1:]:
        out = out.unionByName(s)
    return out


# ---------------------------------------------------------------------------- splits


def split(
    df: DataFrame,
    share: float = VALIDATION_SHARE,
    label: str | None = LABEL,
    seed: int = 0,
    row_id: str = ROW_ID,
    name: str = "is_valid",
) -> DataFrame:
    """Mark the validation rows; with a label, the share holds exactly within each class, null being one."""
    if label is None:
        parts = [(F.lit(True), math.ceil(df.count() * share))]
    else:
        parts = [(F.col(label).eqNullSafe(c), round(n * share)) for c, n in class_counts(df, label).items()]
    return choose(df, draw(seed, row_id), parts, name)


def folds(
    df: DataFrame,
    n: int = FOLDS,
    label: str = LABEL,
    seed: int = 0,
    row_id: str = ROW_ID,
    name: str = "fold",
    exact: bool = True,
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Stratified folds: exact (rank of the draw in its class) or by hash alone (no shuffle)."""
    if not exact:
        return df.withColumn(name, F.floor(uniform(seed, row_id) * n).cast("int"))
    ranked = row_index(df.withColumn("__h", draw(seed, row_id)), ["__h"], "__r", [label], scale=scale)
    return ranked.withColumn(name, F.pmod("__r", F.lit(n)).cast("int")).drop("__h", "__r")


def double_holdout(
    df: DataFrame,
    label: str = LABEL,
    seed: int = 0,
    row_id: str = ROW_ID,
    rows: int = HOLDOUT_ROWS,
    share: float = HOLDOUT_SHARE,
    name: str = "part",
) -> DataFrame:
    """A second hold-out besides validation: ``holdout``, ``valid`` or ``train`` per row."""
    total = df.count()
    first = rows / total if total > 10 * rows else share
    held = split(df, first, label, f"{seed}|hold", row_id, "__hold")
    rest = split(held.filter("not __hold"), VALIDATION_SHARE, label, seed, row_id, "__valid")
    named = rest.select(*df.columns, F.when(F.col("__valid"), "valid").otherwise("train").alias(name))
    return named.unionByName(held.filter("__hold").select(*df.columns, F.lit("holdout").alias(name)))


def permute_label(
    df: DataFrame,
    label: str = LABEL,
    seed: int = 0,
    row_id: str = ROW_ID,
    name: str = "permuted",
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Give every row the label of another row: two random orders matched by position."""
    target = df.withColumn("__h", draw(f"{seed}|to", row_id))
    source = df.select(draw(f"{seed}|from", row_id).alias("__g"), F.col(label).alias(name))
    left = row_index(target, ["__h"], "__i", scale=scale).drop("__h")
    right = row_index(source, ["__g"], "__i", scale=scale).select("__i", name)
    return left.join(right, "__i").drop("__i")


def nth_numbers(df: DataFrame, number: Column, ranks: Sequence[int]) -> list[int]:
    """The values at some ranks (1-based, at most the row count) of a column of 64-bit draws.

    Like ``nth``: each pass counts the next bits of the numbers in the cells that hold a rank, and small cells
    are collected. All ranks share the passes.
    """
    rows = df.select(number.alias("h"))
    answer: dict[int, int] = {}
    left: dict[int, tuple[int | None, int]] = {r: (None, r) for r in ranks}  # rank: its cell, its place there
    shift = 64
    while left:
        cells = sorted({c for c, _ in left.values() if c is not None})
        within = rows.filter(F.shiftright("h", shift).isin(cells)) if cells else rows
        finer = max(0, shift - _BITS)
        found = within.groupBy(F.shiftright("h", finer).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
        counted = sorted((r["c"], r["n"]) for r in found)
        sizes = dict(counted)
        for rank, (cell, place) in left.items():
            for c, n in counted:
                if cell is not None and c >> (shift - finer) != cell:
                    continue
                if place <= n:
                    left[rank] = (c, place)
                    break
                place -= n
        shift = finer
        if not shift:
            answer |= {rank: c for rank, (c, _) in left.items()}
            break
        small = sorted({c for c, _ in left.values() if sizes[c] <= _FEW})
        held: dict[int, list[int]] = {c: [] for c in small}
        if small:
            for r in rows.filter(F.shiftright("h", shift).isin(small)).collect():
                held[r["h"] >> shift].append(r["h"])
        answer |= {rank: sorted(held[c])[place - 1] for rank, (c, place) in left.items() if c in held}
        left = {rank: at for rank, at in left.items() if at[0] not in held}
    return [answer[r] for r in ranks]


def permute_classes(
    df: DataFrame, sizes: dict, label: str = LABEL, seed: int | str = 0, row_id: Sequence[str] = (ROW_ID,)
) -> Column:
    """The classes of all rows dealt out anew at random, as an expression: no rows are moved or matched.

    The rows with the smallest draws get the first class, as many as it has (``sizes``, from ``class_counts``), the
    next ones the second, and so on, which gives every arrangement of the labels the same chance. ``row_id`` are
    columns that tell rows apart: rows alike in them share a draw and so a class.
    """
    kind = df.schema[label].dataType
    classes = sorted(sizes, key=lambda c: (c is None, 0 if c is None else c))
    ends = [sum(sizes[c] for c in classes[: i + 1]) for i in range(len(classes) - 1)]
    number = F.xxhash64(F.lit(str(seed)), *row_id)
    out = F.lit(classes[-1] if classes else None).cast(kind)
    for c, cut in reversed(list(zip(classes, nth_numbers(df, number, ends), strict=False))):
        out = F.when(number <= F.lit(cut), F.lit(c).cast(kind)).otherwise(out)
    return out
