"""Tree models on MLlib: training with early stopping, search, out-of-fold scores, scoring."""

from __future__ import annotations

import random
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions.aggregates import class_counts, roc_auc
from relweave.operators.sampling import (
    FOLDS,
    TRAIN_ROWS,
    balance_down,
    balance_up,
    folds,
    fresh_negatives,
    split,
    stratified_sample,
    with_class_weights,
)
from relweave.schema import LABEL, ROW_ID
from relweave.session import materialize, shared_dir

FEATURES = "features"

# The default parameters and the search space of the tuning step.
BASE_PARAMS = {"max_depth": 6, "feature_fraction": 0.8, "bagging_fraction": 0.8, "learning_rate": 0.1}
SEARCH_SPACE = {
    "max_depth": [2, 3, 4, 5, 6, 7, 8, 9],
    "feature_fraction": [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9],
    "bagging_fraction": [0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95],
    "boosting_type": ["gbdt", "rf"],
}
STAGES = (
    {"max_depth": [3, 5, 7, 9]},
    {"min_data_in_leaf": [10, 14, 18, 22, 26, 30, 34, 38, 42, 46]},
    {"feature_fraction": [0.5, 0.6, 0.7, 0.8, 0.9], "bagging_fraction": [0.6, 0.7, 0.8, 0.9, 1.0]},
    {"min_gain": [0.0, 0.0001, 0.001, 0.01]},
)
FINAL_ROUNDS = 300
STOP_TOLERANCE = 0.001


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (ROW_ID, LABEL)) -> DataFrame:
    """Kept columns plus one feature vector; MLlib takes no nulls, they become 0."""
    cols = [c for c in keep if c in df.columns]
    cast = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in features]
    flat = df.select(*[F.col(c).alias(f"__keep_{c}") for c in cols], *cast)
    out = VectorAssembler(inputCols=list(features), outputCol="__features").transform(flat)
    return out.select(*[F.col(f"__keep_{c}").alias(c) for c in cols], F.col("__features").alias(FEATURES))


def _common(params: dict, seed: int) -> dict:
    return {
        "featuresCol": FEATURES,
        "maxDepth": int(params.get("max_depth", 6)),
        "subsamplingRate": float(params.get("bagging_fraction", 1.0)),
        "featureSubsetStrategy": str(params.get("feature_fraction", "auto")),
        "minInstancesPerNode": int(params.get("min_data_in_leaf", 1)),
        "minInfoGain": float(params.get("min_gain", 0.0)),
        "seed": seed,
        "cacheNodeIds": False,
    }


def boosted_trees(params: dict, rounds: int, label: str = LABEL, valid: str | None = None, seed: int = 0):
    """Boosted trees; with a validation mark, rounds stop once validation stops improving."""
    est = GBTClassifier(
        labelCol=label, maxIter=rounds, stepSize=float(params.get("learning_rate", 0.1)),
        validationTol=STOP_TOLERANCE, **_common(params, seed),
    )
    return est.setValidationIndicatorCol(valid) if valid else est


def random_forest(params: dict, trees: int, label: str = LABEL, seed: int = 0):
    return RandomForestClassifier(labelCol=label, numTrees=trees, **_common(params, seed))


def train(rows: DataFrame, params: dict, rounds: int, label: str = LABEL, valid: str | None = None, seed: int = 0):
    """Fit one model on an assembled table; ``boosting_type`` picks boosting or forest."""
    if params.get("boosting_type", "gbdt") == "rf":
        used = rows.filter(~F.col(valid)) if valid else rows
        return random_forest(params, rounds, label, seed).fit(used)
    return boosted_trees(params, rounds, label, valid, seed).fit(rows)


def score(model, rows: DataFrame, name: str = "score", keep: Sequence[str] = (ROW_ID, LABEL)) -> DataFrame:
    """Kept columns and the probability of class 1."""
    cols = [c for c in keep if c in rows.columns]
    return model.transform(rows).select(*cols, vector_to_array("probability")[1].alias(name))


def node_table(model) -> DataFrame:
    """The nodes of a tree ensemble as rows, read back from its saved form."""
    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    return spark.read.parquet(f"{path}/data")


# --------------------------------------------------------------------------- search


@dataclass
class Trial:
    """One parameter set: its mean validation AUC and which number it has in the score table.

    ``rounds`` is the mean number of trees its folds trained before they stopped, ``curve`` their mean
    validation loss after each of them, and ``held_auc`` the AUC on rows held out of the whole search."""

    number: int
    params: dict
    auc: float
    rounds: float = 0.0
    curve: tuple[float, ...] = ()
    held_auc: float | None = None


def sample_params(n: int, seed: int = 0, space: dict = SEARCH_SPACE) -> list[dict]:
    """The base parameters and n - 1 random draws from the space."""
    rng = random.Random(seed)
    return [dict(BASE_PARAMS)] + [
        {**BASE_PARAMS, **{k: rng.choice(v) for k, v in space.items()}} for _ in range(n - 1)
    ]


def cross_validate(
    rows: DataFrame, candidates: Sequence[dict], rounds: int, n_folds: int = FOLDS,
    label: str = LABEL, row_id: str = ROW_ID, seed: int = 0, parallelism: int = 4, start: int = 0,
    early: bool = False, held: DataFrame | None = None, numbers: Sequence[int] | None = None, curves: bool = False,
) -> tuple[list[Trial], DataFrame]:
    """Out-of-fold scores of every candidate, (trial, row_id, label, fold, p), and their AUCs.

    ``rows`` is assembled and has a ``fold`` column. All AUCs come from one grouped job. With ``early``,
    a fold stops adding trees once the loss on its validation rows stops falling. ``held`` are assembled rows
    outside the search; each candidate's fold models score them together. ``numbers`` are the
    candidates' trial numbers, from ``start`` on if not given.
    """
    numbers = list(numbers) if numbers is not None else [start + i for i in range(len(candidates))]

    def one(job: tuple[int, dict, int]) -> tuple[DataFrame, DataFrame | None, int, list[float]]:
        number, params, k = job
        own = rows.withColumn("__valid", F.col("fold") == k)
        valid = own.filter("__valid")
        model = train(own if early else own.filter("not __valid"), params, rounds, label, "__valid" if early else None, seed)
        boosted = hasattr(model, "evaluateEachIteration")
        curve = model.evaluateEachIteration(valid.withColumn("label", F.col(label).cast("double"))) if curves and boosted else []
        part = score(model, valid, "p", (row_id, label, "fold")).withColumn("trial", F.lit(number))
        more = None if held is None else score(model, held, "p", (row_id, label)).withColumn("trial", F.lit(number))
        return part, more, model.getNumTrees, list(curve)

    jobs = [(n, p, k) for n, p in zip(numbers, candidates, strict=True) for k in range(n_folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, jobs))
    out = materialize(_stacked([p[0] for p in parts]).select("trial", row_id, label, "fold", "p"))
    per_fold = roc_auc(out, "p", label, ["trial", "fold"])
    auc = {r["trial"]: r["a"] for r in per_fold.groupBy("trial").agg(F.avg("auc").alias("a")).collect()}
    held_auc: dict[int, float] = {}
    if held is not None:
        scored = _stacked([p[1] for p in parts]).groupBy("trial", row_id, label).agg(F.avg("p").alias("p"))
        held_auc = {r["trial"]: r["auc"] for r in roc_auc(materialize(scored), "p", label, ["trial"]).collect()}
    trials = []
    for i, (n, p) in enumerate(zip(numbers, candidates, strict=True)):
        own = parts[i * n_folds : (i + 1) * n_folds]
        length = min(len(x[3]) for x in own)
        curve = tuple(sum(x[3][j] for x in own) / n_folds for j in range(length))
        trials.append(Trial(n, p, auc.get(n) or 0.0, sum(x[2] for x in own) / n_folds, curve, held_auc.get(n)))
    return trials, out


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The shares of the rounds after which a race drops candidates.
RUNGS = (0.25, 0.5, 1.0)


def race(
    rows: DataFrame, candidates: Sequence[dict], rounds: int, n_folds: int = FOLDS,
    label: str = LABEL, row_id: str = ROW_ID, seed: int = 0, parallelism: int = 4, least: int = 1,
    early: bool = False, held: DataFrame | None = None, rungs: Sequence[float] = RUNGS, curves: bool = False,
) -> tuple[list[Trial], DataFrame]:
    """Cross-validation by successive halving: all candidates for few rounds, the better half for more.

    A trial that drops out keeps the AUC, the rounds and the curve it had then; only those that run to the
    end have scores. Boosting is the same up to any round, so a trial that stays is the one of a full
    run. At least ``least`` stay.
    """
    left = list(enumerate(candidates))
    trials: dict[int, Trial] = {}
    for share in rungs:
        amount = max(1, round(rounds * share))
        found, scores = cross_validate(
            rows, [p for _, p in left], amount, n_folds, label, row_id, seed, parallelism,
            early=early, held=held, numbers=[n for n, _ in left], curves=curves,
        )
        trials |= {t.number: t for t in found}
        keep = max(least, -(-len(left) // 2))
        best = {t.number for t in sorted(found, key=lambda t: (-t.auc, t.number))[:keep]}
        left = [x for x in left if x[0] in best]
    return [trials[n] for n in sorted(trials)], scores


def prepare_trials(
    df: DataFrame, features: Sequence[str], rows: int = TRAIN_ROWS, n_folds: int = FOLDS, label: str = LABEL,
    row_id: str = ROW_ID, seed: int = 0,
) -> DataFrame:
    """The stratified sample trials run on, with folds and assembled features."""
    sample = materialize(stratified_sample(df, rows, label, seed, row_id))
    marked = folds(sample, n_folds, label, seed, row_id)
    return materialize(assemble(marked, features, (row_id, label, "fold")))


def random_search(
    df: DataFrame, features: Sequence[str], trials: int = 10, rounds: int = 20, n_folds: int = FOLDS,
    label: str = LABEL, row_id: str = ROW_ID, seed: int = 0, parallelism: int = 4, rows: int = TRAIN_ROWS,
    space: dict = SEARCH_SPACE, early: bool = False, held: DataFrame | None = None, racing: int = 0,
) -> tuple[list[Trial], DataFrame]:
    """Random search by stratified cross-validation on a bounded sample.

    ``early`` and ``held`` as in ``cross_validate``; with ``racing``, candidates are halved twice on the way
    and at least so many of them run to the end (``race``)."""
    prepared = prepare_trials(df, features, rows, n_folds, label, row_id, seed)
    params = sample_params(trials, seed, space)
    held = None if held is None else materialize(assemble(held, features, (row_id, label)))
    if racing:
        return race(prepared, params, rounds, n_folds, label, row_id, seed, parallelism, racing, early, held)
    return cross_validate(prepared, params, rounds, n_folds, label, row_id, seed, parallelism, early=early, held=held)


def score_all(
    df: DataFrame, features: Sequence[str], trials: Sequence[Trial], scores: DataFrame, rounds: int = 20,
    label: str = LABEL, row_id: str = ROW_ID, seed: int = 0,
) -> DataFrame:
    """Scores of every row by every trial, (trial, row_id, label, fold, p).

    Rows of the sample keep their out-of-fold ``scores``; each trial is fitted again on the whole sample
    for all others, whose fold is null.
    """
    drawn = scores.select(row_id).distinct()
    sample = materialize(assemble(df.join(drawn, row_id, "left_semi"), features, (row_id, label)))
    rest = materialize(assemble(df.join(drawn, row_id, "left_anti"), features, (row_id, label)))
    if rest.isEmpty():
        return scores
    out, fold = scores, F.lit(None).cast(scores.schema["fold"].dataType)
    for t in trials:
        model = train(sample, t.params, rounds, label, seed=seed)
        part = score(model, rest, "p", (row_id, label)).withColumn("trial", F.lit(t.number)).withColumn("fold", fold)
        out = out.unionByName(part)
    return materialize(out)


def staged_search(
    df: DataFrame, features: Sequence[str], per_stage: int = 6, rounds: int = 20, n_folds: int = FOLDS,
    label: str = LABEL, row_id: str = ROW_ID, seed: int = 0, parallelism: int = 4, rows: int = TRAIN_ROWS,
    stages: Sequence[dict] = STAGES, early: bool = False, held: DataFrame | None = None,
) -> tuple[list[Trial], DataFrame]:
    """Tune tree shape, then leaves, then sampling, then regularisation, keeping the best each time."""
    held = None if held is None else materialize(assemble(held, features, (row_id, label)))
    prepared = prepare_trials(df, features, rows, n_folds, label, row_id, seed)
    rng, best, found, scores = random.Random(seed), dict(BASE_PARAMS), [], None
    for space in stages:
        picks = [{**best, **{k: rng.choice(v) for k, v in space.items()}} for _ in range(per_stage)]
        picks = [p for i, p in enumerate(picks) if p not in picks[:i]]
        trials, oof = cross_validate(
            prepared, picks, rounds, n_folds, label, row_id, seed, parallelism, start=len(found), early=early, held=held
        )
        found += trials
        scores = oof if scores is None else scores.unionByName(oof)
        best = dict(max(found, key=lambda t: (t.auc, -t.number)).params)
    return found, scores


# ------------------------------------------------------------------- final ensemble


def train_final(
    df: DataFrame, features: Sequence[str], chosen: Sequence[dict], rounds: int = FINAL_ROUNDS, label: str = LABEL,
    row_id: str = ROW_ID, seed: int = 0, imbalance: str | None = None,
) -> list:
    """Fit every chosen parameter set on the training split, stopping on the validation split.

    ``imbalance``: with ``fresh``, every member gets all positives and its own slice of the negatives; with
    ``down`` or ``up`` the training split is balanced once. The validation split keeps its classes as they are.
    """
    marked = split(df, label=label, seed=seed, row_id=row_id)
    rows = materialize(assemble(marked, features, (row_id, label, "is_valid")))
    fitted, valid = rows.filter("not is_valid"), rows.filter("is_valid")
    if imbalance in ("down", "up"):
        balanced = balance_down(fitted, label, seed, row_id) if imbalance == "down" else balance_up(fitted, label, seed, row_id).drop("copy")
        rows = materialize(balanced.unionByName(valid))
    elif imbalance not in (None, "fresh"):
        raise ValueError(f"unknown imbalance option {imbalance!r}")
    models = []
    for i, p in enumerate(chosen):
        own = rows
        if imbalance == "fresh":
            own = fresh_negatives(fitted, i, len(chosen), label, seed=seed, row_id=row_id).unionByName(valid)
        models.append(train(own, p, rounds, label, "is_valid", seed + i))
    return models


def bagged_score(models: Sequence, rows: DataFrame, name: str = "score", keep: Sequence[str] = (ROW_ID,)) -> DataFrame:
    """Mean probability of the models, in one pass over the rows."""
    out = rows
    for i, m in enumerate(models):
        out = m.setPredictionCol("").setRawPredictionCol(f"__raw{i}").setProbabilityCol(f"__prob{i}").transform(out)
    total = F.lit(0.0)
    for i in range(len(models)):
        total = total + vector_to_array(f"__prob{i}")[1]
    return out.select(*[c for c in keep if c in out.columns], (total / F.lit(float(len(models)))).alias(name))


def stack_rows(scores: DataFrame, trials: Sequence[int], row_id: str = ROW_ID, label: str = LABEL) -> DataFrame:
    """One row per training row with the out-of-fold score of every trial as a column."""
    wide = scores.groupBy(row_id, label).pivot("trial", list(trials)).agg(F.first("p"))
    return wide.select(row_id, label, *[F.col(str(t)).alias(f"p_{t}") for t in trials])


def train_stacker(
    scores: DataFrame, trials: Sequence[int], method: str = "trees", label: str = LABEL, row_id: str = ROW_ID, seed: int = 0,
    rounds: int = 20,
):
    """Fit the second-level model on out-of-fold scores: balanced logistic or boosted trees."""
    wide = stack_rows(scores, trials, row_id, label)
    features = [f"p_{t}" for t in trials]
    if method == "logistic":
        weighted = with_class_weights(wide, label)
        rows = assemble(weighted, features, (row_id, label, "weight"))
        return LogisticRegression(featuresCol=FEATURES, labelCol=label, weightCol="weight").fit(rows)
    if method != "trees":
        raise ValueError(f"unknown stacking method {method!r}")
    marked = split(wide, 0.1, label, seed, row_id)
    rows = materialize(assemble(marked, features, (row_id, label, "is_valid")))
    return boosted_trees(BASE_PARAMS, rounds, label, "is_valid", seed).fit(rows)


def class_ratio(df: DataFrame, label: str = LABEL) -> float:
    """Negatives per positive."""
    sizes = class_counts(df, label)
    return sizes.get(0, 0) / max(sizes.get(1, 0), 1)
