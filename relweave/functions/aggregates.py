"""Type-driven aggregation, exact order statistics and label scores.

Order statistics and modes avoid Spark's single-buffer aggregates (``median``, ``mode``)
where one group may be large: they count per value first, which spreads a hot group over the
cluster, and read the answer off a prefix scan of the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.functions.lookup import lookup_join
from relweave.functions.ordered import Scan, key_sizes, prefix_scan, row_index
from relweave.functions.selection import quantiles_of
from relweave.schema import CAT, MULTI, NUM, PREFIXES, TIME, aggregate_name, logical_type
from relweave.session import DEFAULT_SCALE, Scale, materialize

# ------------------------------------------------------------------- type-driven registry

#: Rows of a task that sorts them once per median column.
SORTED_ROWS = 500_000

# The statistics computed per logical type.
NUMERIC_STATISTICS = ("mean", "sum", "std", "median", "min", "max")
CATEGORY_STATISTICS = ("count",)

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "std": F.stddev_samp,
    "median": F.median,
    "median_approx": lambda c: F.percentile_approx(c, 0.5),
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "nunique_approx": F.approx_count_distinct,
    "percent_true": lambda c: F.avg(c.cast("boolean").cast("int")),
}


def statistics_for(ltype: str | None, numeric=NUMERIC_STATISTICS, category=CATEGORY_STATISTICS) -> tuple:
    """The statistics of a logical type; time and multi-category have none."""
    if ltype == NUM:
        return tuple(numeric)
    if ltype == CAT:
        return tuple(category)
    if ltype in (TIME, MULTI):
        raise ValueError(f"columns of type {ltype} cannot be aggregated")
    raise ValueError(f"unknown logical type {ltype!r}; name columns with one of {sorted(PREFIXES.values())}")


def aggregate_by_key(
    df: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    numeric: Sequence[str | Callable[[Column], Column]] = NUMERIC_STATISTICS,
    category: Sequence[str | Callable[[Column], Column]] = CATEGORY_STATISTICS,
    include_key: bool = True,
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """One row per non-null key with the statistics of every numeric and category column.

    A statistic is a registry name or a function from column to aggregate column (a grouped
    pandas UDF works too). The key itself contributes its group size, as a category does.
    Exact medians of keys too large for one task are read from value counts instead.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if logical_type(f) in (NUM, CAT) and f.name != key]
    rows = df.filter(F.col(key).isNotNull())
    aggs, medians = {}, {}
    if include_key:
        aggs[aggregate_name("count", key)] = F.count(F.lit(1))
    for c in columns:
        for s in statistics_for(logical_type(df.schema[c]), numeric, category):
            name = s if isinstance(s, str) else s.__name__
            if s == "median":
                medians[aggregate_name("median", c)] = c
            fn = AGGREGATES[s] if isinstance(s, str) else s
            aggs[aggregate_name(name, c)] = fn(F.col(c))
    if not medians:
        return rows.groupBy(key).agg(*[a.alias(n) for n, a in aggs.items()])
    rows = rows.select(*dict.fromkeys([key, *columns]))
    sizes = key_sizes(rows.select(key), [key], scale)
    if sizes.hot is None:
        return _with_medians(rows, key, aggs, medians, sizes.rows)
    hot = F.broadcast(sizes.hot)
    small = _with_medians(rows.join(hot, key, "left_anti"), key, aggs, medians, sizes.rows - sizes.hot_rows)
    large_rows = rows.join(hot, key, "left_semi")
    others = [a.alias(n) for n, a in aggs.items() if n not in medians]
    large = large_rows.groupBy(key).agg(*(others or [F.count(F.lit(1)).alias("__n")]))
    for n, c in medians.items():
        large = large.join(quantiles(large_rows.select(key, c), c, {n: 0.5}, [key], scale), key, "left")
    return small.unionByName(large.select(key, *aggs))


def _with_medians(rows: DataFrame, key: str, aggs: dict[str, Column], medians: dict[str, str], size: int) -> DataFrame:
    """All statistics of keys small enough to be ordered within one task, from ``size`` rows.

    The rows are shuffled once by key and sorted once per median column, all in one task, which holds every
    sort at once: tasks get a bounded number of rows, however well these compress. The median is the
    mean of the one or two middle rows. Spark's own median would keep a hash map per key and
    column and fall back to sorting serialized maps when there are many keys.
    """
    group = Window.partitionBy(key)
    picks, out = [], []
    for i, c in enumerate(medians.values()):
        picks.append(F.row_number().over(group.orderBy(F.col(c).asc_nulls_last())).alias(f"__r{i}"))
        picks.append(F.count(c).over(group).alias(f"__c{i}"))
    names = list(medians)
    for n, a in aggs.items():
        if n in medians:
            i, value = names.index(n), F.col(medians[n]).cast("double")
            twice = 2 * F.col(f"__r{i}") - F.col(f"__c{i}")
            a = F.avg(F.when(twice.between(0, 2), value))
        out.append(a.alias(n))
    if size > SORTED_ROWS:
        rows = rows.repartition(-(-size // SORTED_ROWS), key)
    return rows.select("*", *picks).groupBy(key).agg(*out)


# -------------------------------------------------------------------- counts and ranks


def value_counts(df: DataFrame, column: str, normalised: str | None = None) -> DataFrame:
    """Rows per non-null value as ``n``, and their share of all such rows if a name is given."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if normalised is None:
        return counts
    total = df.agg(F.count(column)).first()[0]
    return counts.withColumn(normalised, F.col("n") / F.lit(max(total, 1)))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value of each string column, the smallest value on ties."""
    if not columns:
        return {}
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("e")
    ).select("e.*")
    counts = long.filter("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min(F.struct(-F.col("n"), "v")).alias("b"))
    return {r["c"]: r["b"]["v"] for r in best.collect()}


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value of any orderable column, the smallest on ties."""
    counts = value_counts(df, column)
    return counts.agg(F.min(F.struct(-F.col("n"), F.col(column))).alias("b")).select(F.col(f"b.{column}").alias(column))


def value_ranks(df: DataFrame, column: str, name: str = "rank", scale: Scale = DEFAULT_SCALE) -> DataFrame:
    """Every value with its count and its 0-based rank by (count descending, value)."""
    counts = materialize(value_counts(df, column).withColumn("__neg", -F.col("n")))
    return row_index(counts, ["__neg", column], name, scale=scale).drop("__neg")


def most_common(df: DataFrame, key: str, column: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent values per key, as one column per place."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy(F.desc("c"), F.asc(column))
    top = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    places = [F.max(F.when(F.col("r") == i, F.col(column))).alias(f"top{i}_{column}") for i in range(1, n + 1)]
    return top.groupBy(key).agg(*places)


# --------------------------------------------------------------------- order statistics


def quantiles(
    df: DataFrame,
    column: str,
    wanted: dict[str, float],
    key: Sequence[str] = (),
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Exact quantiles with linear interpolation, for the whole table or per key.

    Of a whole table they are found by narrowing (``selection``). Per key: counts per value, a running
    count along the values, then the two neighbours of each quantile position, so that no group is
    ever held in one buffer.
    """
    key = list(key)
    if not key:
        found = quantiles_of(df, {column: list(wanted.values())})[column]
        return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"`{n}` double" for n in wanted))
    vc = materialize(df.filter(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count(F.lit(1)).alias("__n")))
    run = prefix_scan(vc, [column], {"__to": Scan("sum", F.col("__n"))}, key, scale)
    run = run.withColumn("__from", F.col("__to") - F.col("__n"))
    sizes = vc.groupBy(*key).agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__w"))
    run = lookup_join(run, materialize(sizes), key, weight="__w", scale=scale)
    picks = []
    for name, q in wanted.items():
        pos = (F.col("__all") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("__from") <= at) & (at < F.col("__to"))
            picks.append(F.max(F.when(inside, F.col(column).cast("double"))).alias(f"{name}_{side}"))
    found = run.groupBy(*key).agg(F.max("__all").alias("__all"), *picks)
    out = []
    for name, q in wanted.items():
        pos = (F.col("__all") - 1) * F.lit(float(q))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*key, *out)


def average_rank(df: DataFrame, column: str, name: str, scale: Scale = DEFAULT_SCALE) -> DataFrame:
    """Rank of each value in [0, 1], ties averaged; null stays null."""
    vc = materialize(value_counts(df, column))
    total = vc.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    run = prefix_scan(vc, [column], {"__to": Scan("sum", F.col("n"))}, scale=scale)
    mean_rank = F.col("__to") - (F.col("n") - 1) / F.lit(2.0)
    ranks = materialize(run.select(column, "n", (mean_rank / F.lit(max(total, 1))).alias(name)))
    return lookup_join(df, ranks, [column], weight="n", scale=scale)


def extent(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """(min, max) of every column from one pass."""
    row = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for f, p in ((F.min, "a"), (F.max, "b"))]).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}


# ------------------------------------------------------------------------ label scores


def class_counts(df: DataFrame, label: str = "label") -> dict:
    """Rows per class."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), scale: Scale = DEFAULT_SCALE) -> DataFrame:
    """Exact area under the ROC curve with ties counted half, for the table or per group.

    Works on counts per distinct score: each positive beats the negatives below its score
    and half of those tied with it. Rows without a label are left out.
    """
    by = list(by)
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("__p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("__q"),
    )
    counts = materialize(counts)
    run = prefix_scan(counts, [score], {"__below": Scan("sum", F.col("__q"))}, by, scale)
    won = F.col("__p") * (F.col("__below") - F.col("__q") + F.col("__q") / F.lit(2.0))
    sums = run.groupBy(*by).agg(F.sum(won).alias("w"), F.sum("__p").alias("p"), F.sum("__q").alias("q"))
    pairs = F.col("p").cast("double") * F.col("q").cast("double")
    return sums.select(*by, F.try_divide(F.col("w"), pairs).alias("auc"))


def f1_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """F1 of the score rounded to 0 or 1 (half to even)."""
    hit = F.bround(F.col(score), 0) == 1
    pos = F.col(label) == 1
    tp, fp, fn = (F.count_if(c) for c in (hit & pos, hit & ~pos, ~hit & pos))
    return df.agg(F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def label_correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of every feature with the label, (feature, r); 0 for a constant."""
    y = F.col(label).cast("double")
    means = df.agg(F.avg(y).alias("__y"), *[F.avg(c).alias(c) for c in features]).first()
    dy = y - F.lit(means["__y"])
    aggs = []
    for i, c in enumerate(features):
        dx = F.col(c).cast("double") - F.lit(means[c]).cast("double")
        both = F.col(c).isNotNull() & y.isNotNull()
        aggs += [
            F.sum(F.when(both, dx * dy)).alias(f"xy{i}"),
            F.sum(F.when(both, dx * dx)).alias(f"xx{i}"),
            F.sum(F.when(both, dy * dy)).alias(f"yy{i}"),
            F.sum(F.when(both, dx)).alias(f"x{i}"),
            F.sum(F.when(both, dy)).alias(f"y{i}"),
            F.count_if(both).alias(f"n{i}"),
        ]
    row = df.agg(*aggs)
    pairs = []
    for i, c in enumerate(features):
        n = F.col(f"n{i}")
        cov = F.col(f"xy{i}") - F.try_divide(F.col(f"x{i}") * F.col(f"y{i}"), n)
        vx = F.col(f"xx{i}") - F.try_divide(F.col(f"x{i}") ** 2, n)
        vy = F.col(f"yy{i}") - F.try_divide(F.col(f"y{i}") ** 2, n)
        r = F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
        pairs.append(F.struct(F.lit(c).alias("feature"), F.coalesce(r, F.lit(0.0)).alias("score")))
    return row.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")


def chi_square_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-square of non-negative feature sums per class against their class-share expectation."""
    sums = df.groupBy(label).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)]
    )
    arrays = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("o")) for i, c in enumerate(features)])
    long = sums.select("__n", F.explode(arrays).alias("e")).select("__n", "e.*")
    totals = long.groupBy("feature").agg(F.sum("o").alias("all"), F.sum("__n").alias("rows"))
    e = F.col("all") * F.col("__n") / F.col("rows")
    term = F.try_divide((F.col("o") - e) * (F.col("o") - e), e)
    return long.join(totals, "feature").groupBy("feature").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("score"))


def information_gain(df: DataFrame, feature: Column, label: str) -> DataFrame:
    """Entropy of the label minus its entropy within the values (or bins) of a feature."""
    counts = df.groupBy(feature.alias("__b"), F.col(label).alias("__y")).agg(F.count(F.lit(1)).alias("c"))
    per_bin = counts.groupBy("__b").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2("c")).alias("h"))
    inner = per_bin.agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.log2("t") - F.col("h")).alias("inner"))
    per_class = counts.groupBy("__y").agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * F.log2("t")).alias("outer"))
    both = inner.withColumn("__one", F.lit(1)).join(per_class.withColumn("__one", F.lit(1)), "__one")
    n = F.col("n")
    return both.select((F.log2(n) - F.col("outer") / n - F.col("inner") / n).alias("gain"))
