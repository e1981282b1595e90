"""Feature selection: forest importance, correlation, chi-square, null and permutation
importance, information gain, backward elimination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.functions.aggregates import (
    chi_square_scores,
    class_counts,
    extent,
    information_gain,
    label_correlations,
    quantiles,
    roc_auc,
)
from relweave.functions.ordered import lag
from relweave.functions.scalars import log_ratio_score, min_max_scale
from relweave.operators.cells import bin_edges, bin_of, fits, importances
from relweave.operators.sampling import permute_classes, split
from relweave.plans.models import FEATURES, assemble, node_table, random_forest, score
from relweave.schema import LABEL, ROW_ID
from relweave.session import materialize

# The forest used for importance, and the share of features kept.
FOREST = {"max_depth": 8, "bagging_fraction": 0.8, "feature_fraction": "sqrt"}
FOREST_TREES = 200
KEEP_RATIO = 0.8
MEDIAN_FACTOR = 1.25
NULL_RUNS = 10
FEW_TREES = 20  # forests of more are grown on cells: of so few, the passes over the rows cost more than the trees


def keep_count(n_features: int, ratio: float = KEEP_RATIO, rows: int | None = None) -> int:
    """How many features to keep; with ``rows``, a tenth of the rows if that is less."""
    if rows is not None and int(0.1 * rows) <= n_features:
        return int(0.1 * rows)
    return int(ratio * n_features)


def forest_importance(
    df: DataFrame, features: Sequence[str], label: str = LABEL, trees: int = FOREST_TREES, seed: int = 0, **params
) -> DataFrame:
    """(feature, gain, split) of a forest: summed gains weighted by node rows, and split counts."""
    rows = assemble(df, features, (label,))
    return model_importance(random_forest({**FOREST, **params}, trees, label, seed).fit(rows), features)


def model_importance(model, features: Sequence[str]) -> DataFrame:
    """(feature, gain, split) of a fitted forest."""
    nodes = node_table(model)
    used = (
        nodes.filter("nodeData.leftChild >= 0")
        .groupBy(F.col("nodeData.split.featureIndex").alias("i"))
        .agg(
            F.sum(F.col("nodeData.gain") * F.col("nodeData.rawCount")).alias("gain"),
            F.count(F.lit(1)).alias("split"),
        )
    )
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "i int, feature string")
    out = names.join(used, "i", "left").fillna({"gain": 0.0, "split": 0})
    return out.select("feature", "gain", "split")


def top_features(scores: DataFrame, n: int, by: str = "score") -> list[str]:
    """The n best features by descending score (name on ties)."""
    return [r["feature"] for r in scores.orderBy(F.desc(by), "feature").limit(n).collect()]


def select_by_importance(df: DataFrame, features: Sequence[str], label: str = LABEL, n: int | None = None, **kw):
    """The n features of highest gain; only the useful ones if fewer have any gain."""
    n = keep_count(len(features)) if n is None else n
    scores = materialize(forest_importance(df, features, label, **kw))
    useful = scores.filter("gain > 0 and split > 0")
    return top_features(useful, n, "gain")


def select_by_correlation(df: DataFrame, features: Sequence[str], label: str = LABEL, n: int | None = None):
    """The n features of largest absolute correlation with the label, weakest first."""
    n = keep_count(len(features)) if n is None else n
    scores = label_correlations(df, features, label).withColumn("a", F.abs("score"))
    return top_features(scores, n, "a")[::-1]


def select_by_chi_square(df: DataFrame, features: Sequence[str], label: str = LABEL, n: int | None = None):
    """The n features of largest chi-square after min-max scaling, in column order."""
    n = keep_count(len(features)) if n is None else n
    scaled = min_max_scale(df.select(label, *features), features)
    scores = chi_square_scores(scaled, [f"{f}_mm" for f in features], label)
    kept = set(top_features(scores, n))
    return [f for f in features if f"{f}_mm" in kept]


def select_above_median(df: DataFrame, features: Sequence[str], label: str = LABEL, factor: float = MEDIAN_FACTOR, **kw):
    """Features whose split count reaches the factor times the median count."""
    scores = materialize(forest_importance(df, features, label, **kw))
    bar = quantiles(scores, "split", {"m": 0.5}).first()["m"] * factor
    kept = {r["feature"] for r in scores.filter(F.col("split") >= bar).collect()}
    return [f for f in features if f in kept]


def null_importance(
    df: DataFrame, features: Sequence[str], label: str = LABEL, runs: int = NULL_RUNS, seed: int = 0,
    row_id: str = ROW_ID, trees: int = FOREST_TREES, **params,
) -> DataFrame:
    """Scores of each feature against forests fitted on permuted labels.

    ``*_log``: log ratio of the actual importance to the upper quartile of the null ones;
    ``*_score``: percentage of null importances below the actual one.
    """
    if trees > FEW_TREES:
        found = _on_cells(df, features, label, runs, seed, row_id, trees, {**FOREST, **params})
        if found is not None:
            return null_scores(*found)
    # One table of vectors for all forests; a row is its id and its place in that table, as ids may repeat.
    rows = materialize(assemble(df, features, (row_id, label)).withColumn("__at", F.monotonically_increasing_id()))
    sizes = class_counts(rows, label)

    def importance(fitted: DataFrame, y: str, forest_seed: int) -> DataFrame:
        return model_importance(random_forest({**FOREST, **params}, trees, y, forest_seed).fit(fitted), features)

    actual = importance(rows.select(label, FEATURES), label, seed).select(
        "feature", F.col("gain").alias("gain_actual"), F.col("split").alias("split_actual")
    )
    nulls = None
    for run in range(runs):
        mixed = permute_classes(rows, sizes, label, f"{seed}-{run}", (row_id, "__at"))
        one = importance(rows.select(mixed.alias("__y"), FEATURES), "__y", seed + run + 1).withColumn("run", F.lit(run))
        nulls = one if nulls is None else nulls.unionByName(one)
    return null_scores(actual, nulls)


def _on_cells(
    df: DataFrame, features: Sequence[str], label: str, runs: int, seed: int, row_id: str, trees: int, params: dict
) -> tuple[DataFrame, DataFrame] | None:
    """The actual and the null importances from forests grown on cells, counted in one pass for all
    labels; null if the table has too many cells."""
    cast = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    inputs = [f"__f{i}" for i in range(len(features))]
    named = [c.alias(name) for c, name in zip(cast, inputs, strict=True)]
    rows = df.select(F.col(row_id).alias("__id"), F.col(label).alias("__y"), *named)
    rows = materialize(rows.withColumn("__at", F.monotonically_increasing_id()))
    sizes = class_counts(rows, "__y")
    if not sizes or any(c is None or c < 0 or c != int(c) for c in sizes):
        raise ValueError(f"classes must be whole numbers from 0 on, not {sorted(map(str, sizes))}")
    edges = bin_edges(rows, inputs)
    places = [bin_of(F.col(c), e) for c, e in zip(inputs, edges, strict=True)]
    if not fits(rows, places, edges):
        return None
    labels = [F.col("__y"), *[permute_classes(rows, sizes, "__y", f"{seed}-{run}", ("__id", "__at")) for run in range(runs)]]
    names = [[f"__n{i}_{k}" for k in range(int(max(sizes)) + 1)] for i in range(len(labels))]
    counts = [F.count_if(y == k).alias(n) for y, own in zip(labels, names, strict=True) for k, n in enumerate(own)]
    cells = rows.groupBy(*[p.alias(f"__b{i}") for i, p in enumerate(places)]).agg(*counts)
    bins = [f"__b{i}" for i in range(len(inputs))]
    found = importances(cells, bins, names, [seed + i for i in range(runs + 1)], trees, params)
    actual = [(f, *one) for f, one in zip(features, found[0], strict=True)]
    nulls = [(f, *one, run) for run, every in enumerate(found[1:]) for f, one in zip(features, every, strict=True)]
    return (
        df.sparkSession.createDataFrame(actual, "feature string, gain_actual double, split_actual bigint"),
        df.sparkSession.createDataFrame(nulls, "feature string, gain double, split bigint, run int"),
    )


def null_scores(actual: DataFrame, nulls: DataFrame) -> DataFrame:
    """Compare actual importances with those of the null runs, per feature."""
    both = nulls.join(actual, "feature")
    aggs = []
    for m in ("split", "gain"):
        p75 = F.percentile(F.col(m).cast("double"), 0.75)
        aggs.append(log_ratio_score(F.first(f"{m}_actual").cast("double"), p75).alias(f"{m}_log"))
        below = F.count_if(F.col(m) < F.col(f"{m}_actual"))
        aggs.append((100.0 * below / F.count(F.lit(1))).alias(f"{m}_score"))
    return both.groupBy("feature").agg(*aggs)


def select_by_null_importance(df: DataFrame, features: Sequence[str], label: str = LABEL, **kw) -> list[str]:
    """Features that split more often than in some null run, best gain score first."""
    scores = null_importance(df, features, label, **kw).filter("split_score > 0")
    rows = scores.orderBy(F.desc("gain_score"), F.desc("split_score"), "feature").collect()
    return [r["feature"] for r in rows]


_DONOR = "__donor"


def shuffle_rows(df: DataFrame, columns: Sequence[str], seed: int = 0, row_id: str = ROW_ID) -> DataFrame:
    """The rows with the ``columns`` of another row each, as a struct ``__donor``: every row is a donor once.

    The rows are put in one random order and each gets the row before it, the first one the last. So the
    donors of all columns cost one order. The draw is of the row id and the row's place in the table as it
    is written here, since ids may repeat.
    """
    at, drawn, values = F.col("__at"), F.col("__h"), F.struct(*columns)
    rows = materialize(df.withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__h", F.xxhash64(F.lit(f"{seed}|donor"), row_id, at)).withColumn("__own", values)
    last = rows.agg(F.max_by("__own", F.struct(drawn, at)).alias("v"))
    before = lag(rows, ["__h", "__at"], {_DONOR: "__own"})
    first = F.col(_DONOR).isNull()  # a row's own struct never is
    out = before.join(F.broadcast(last)).withColumn(_DONOR, F.when(first, F.col("v")).otherwise(F.col(_DONOR)))
    return materialize(out.drop("__at", "__h", "__own", "v"))


def permutation_importance(
    df: DataFrame, features: Sequence[str], label: str = LABEL, trees: int = FOREST_TREES, seed: int = 0,
    row_id: str = ROW_ID, **params,
) -> DataFrame:
    """(feature, score): loss of AUC on held-out rows when one feature is shuffled among them."""
    marked = materialize(split(df.select(row_id, label, *features), label=label, seed=seed, row_id=row_id))
    fitted = marked.filter("not is_valid")
    model = random_forest({**FOREST, **params}, trees, label, seed).fit(assemble(fitted, features, (label,)))
    valid = shuffle_rows(marked.filter("is_valid").drop("is_valid"), features, seed, row_id)
    parts = score(model, assemble(valid, features), "p").withColumn("feature", F.lit(""))
    for f in features:
        mixed = valid.withColumn(f, F.col(f"{_DONOR}.{f}"))
        parts = parts.unionByName(score(model, assemble(mixed, features), "p").withColumn("feature", F.lit(f)))
    auc = materialize(roc_auc(parts, "p", label, ["feature"]))
    base = auc.filter("feature = ''").first()["auc"]
    return auc.filter("feature != ''").select("feature", (F.lit(base) - F.col("auc")).alias("score"))


def select_by_permutation(df: DataFrame, features: Sequence[str], label: str = LABEL, n: int | None = None, **kw):
    """The n features whose shuffling costs most; only those that cost anything if fewer do."""
    n = keep_count(len(features)) if n is None else n
    return top_features(permutation_importance(df, features, label, **kw).filter("score > 0"), n)


def gain_ranking(df: DataFrame, features: Sequence[str], label: str = LABEL, bins: int = 10) -> DataFrame:
    """(feature, score): information gain of each feature cut into equal-width bins."""
    edges = extent(df, features)
    out = None
    for f in features:
        low, high = edges[f]
        width = (high - low) / bins if low is not None else 0
        cell = F.least(F.floor((F.col(f) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
        one = information_gain(df, cell, label).select(F.lit(f).alias("feature"), F.col("gain").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def backward_elimination(
    df: DataFrame, features: Sequence[str], label: str = LABEL, tolerance: float = 0.001, keep_at_least: int = 1,
    drop_share: float = 0.25, trees: int = 20, seed: int = 0, row_id: str = ROW_ID, **params,
) -> list[str]:
    """Drop the least important features step by step while the held-out AUC does not fall."""
    rows = materialize(split(df.select(row_id, label, *features), label=label, seed=seed, row_id=row_id))
    fit_rows, valid = rows.filter("not is_valid"), rows.filter("is_valid")

    def fitted(names: list[str]) -> tuple[object, float]:
        model = random_forest({**FOREST, **params}, trees, label, seed).fit(assemble(fit_rows, names, (label,)))
        return model, roc_auc(score(model, assemble(valid, names), "p"), "p", label).first()["auc"] or 0.0

    kept = list(features)
    model, best = fitted(kept)
    while len(kept) > keep_at_least:
        ranked = model_importance(model, kept).orderBy("gain", "feature").collect()
        out = {r["feature"] for r in ranked[: max(1, int(len(kept) * drop_share))]}
        fewer = [f for f in kept if f not in out]
        if len(fewer) < keep_at_least:
            break
        smaller, now = fitted(fewer)
        if now < best - tolerance:
            break
        kept, model, best = fewer, smaller, max(best, now)
    return kept


def select_features(
    df: DataFrame, features: Sequence[str], method: str = "imp", ratio: float = KEEP_RATIO, label: str = LABEL, **kw
) -> list[str]:
    """Select by method: imp, nh, shap (permutation importance), sfm, cor, chi, gain or backward."""
    n = keep_count(len(features), ratio)
    if method == "imp":
        return select_by_importance(df, features, label, n, **kw)
    if method == "nh":
        return select_by_null_importance(df, features, label, **kw)
    if method == "shap":
        return select_by_permutation(df, features, label, n, **kw)
    if method == "sfm":
        return select_above_median(df, features, label, **kw)
    if method == "cor":
        return select_by_correlation(df, features, label, n)
    if method == "chi":
        return select_by_chi_square(df, features, label, n)
    if method == "gain":
        return top_features(gain_ranking(df, features, label), n)
    if method == "backward":
        return backward_elimination(df, features, label, **kw)
    raise ValueError(f"unknown selection method {method!r}")
