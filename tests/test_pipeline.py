"""Sources and sinks, models, ensembles, the whole pipeline, and the shape of plans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave import DatasetConfig
from relweave.operators import reduce as R
from relweave.operators import selection as L
from relweave.operators.merge import MergeOptions
from relweave.plans import ensemble as M
from relweave.plans import models as T
from relweave.plans.automl import ModelOptions, RelationalModel, run_folder
from relweave.plans.registry import QUERIES
from relweave.session import spread
from relweave.sources.tables import read_labels, read_table, read_test, read_train, write_predictions, write_table

TYPES = {"c_k": "cat", "n_x": "num", "m_s": "multi-cat", "t_01": "time"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A dataset folder: the label follows n_x and the size of the side rows."""
    root = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(0)
    info = {
        "time_budget": 60,
        "time_col": "t_01",
        "tables": {"main": TYPES, "table_1": {"c_k": "cat", "n_q": "num"}},
        "relations": [{"table_A": "main", "table_B": "table_1", "key": ["c_k"], "type": "many_to_many"}],
    }
    for part, n in (("train", 300), ("test", 60)):
        (root / part).mkdir()
        lines, labels = ["\t".join(TYPES)], ["label"]
        for i in range(n):
            x = rng.normal()
            at = "" if i % 13 == 0 else str(1_500_000_000_000 + i * 3_600_000)
            lines.append(f"k{i % 20}\t{'' if i % 17 == 0 else round(x, 4)}\t{','.join(rng.choice(list('abcde'), 2))}\t{at}")
            labels.append(str(int(x + (i % 20) / 20 > 0.5)))
        (root / part / f"main_{part}.data").write_text("\n".join(lines) + "\n")
        if part == "train":
            (root / part / "main_train.solution").write_text("\n".join(labels) + "\n")
            side = ["c_k\tn_q"] + [f"k{i % 20}\t{i % 20}" for i in range(100)]
            (root / part / "table_1.data").write_text("\n".join(side) + "\n")
    (root / "train" / "info.json").write_text(json.dumps(info))
    return str(root)


def test_declaration_round_trip(folder):
    text = open(f"{folder}/train/info.json").read()
    config = DatasetConfig.from_json(text)
    assert DatasetConfig.from_json(config.to_json()) == config
    assert config.relations[0].key == "c_k" and config.extra == {"time_budget": 60}


def test_train_folder_is_typed_and_labelled_in_file_order(spark, folder):
    data = read_train(spark, f"{folder}/train")
    main = data.main.orderBy("row_id").toPandas()
    assert dict(data.main.dtypes)["m_s"] == "array<string>" and dict(data.main.dtypes)["t_01"] == "timestamp"
    assert main.row_id.tolist() == list(range(300)) and main.c_k.tolist()[:3] == ["k0", "k1", "k2"]
    assert main.t_01.isna().sum() == 24 and main.n_x.isna().sum() == 18
    want = [int(x) for x in open(f"{folder}/train/main_train.solution").read().split()[1:]]
    assert main.label.tolist() == want


def test_tables_survive_writing(spark, folder, tmp_path):
    a = read_table(spark, f"{folder}/train/main_train.data", TYPES)
    write_table(a, str(tmp_path / "t"), TYPES)
    b = read_table(spark, str(tmp_path / "t"), TYPES)
    key = [F.col("c_k"), F.col("t_01"), F.col("n_x")]
    assert a.orderBy(*key).collect() == b.orderBy(*key).collect()


def test_predictions_come_back_in_row_order(spark, tmp_path):
    scores = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") / 1000).alias("score")).repartition(5)
    write_predictions(scores, str(tmp_path / "p"))
    back = read_labels(spark, str(tmp_path / "p")).count()
    text = [x for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().split()[1:]]
    assert back == 1000 and [float(x) for x in text] == [i / 1000 for i in range(1000)]


OPTIONS = ModelOptions(
    merge=MergeOptions(numeric=("mean",)), selection_trees=5, trials=2, trial_rounds=3, final_rounds=5, parallelism=2
)


def test_pipeline_over_a_folder(spark, folder, tmp_path):
    scores = run_folder(spark, folder, str(tmp_path / "out"), OPTIONS).toPandas()
    assert sorted(scores.row_id) == list(range(60)) and scores.score.between(0, 1).all()
    assert len(list((tmp_path / "out").glob("part-*"))) >= 1


def test_transform_of_training_rows_repeats_their_features(spark, folder):
    data = read_train(spark, f"{folder}/train")
    model = RelationalModel(ModelOptions(**{**OPTIONS.__dict__, "stacking": "logistic", "choose": "auc"})).fit(data)
    a = model.transform(data.main).select("row_id", *model.features).orderBy("row_id").collect()
    b = model.transform(data.main.repartition(5)).select("row_id", *model.features).orderBy("row_id").collect()
    assert a == b and len(a) == 300
    assert model.predict(read_test(spark, f"{folder}/test", data.config)).count() == 60


def _with(**kw):
    return ModelOptions(**{**OPTIONS.__dict__, **kw})


def test_joint_scope_racing_trees_and_fresh_negatives(spark, folder):
    data, rows = read_train(spark, f"{folder}/train"), None
    rows = read_test(spark, f"{folder}/test", data.config)
    options = _with(joint=True, racing=True, trials=4, objectives=("loss", "agreement", "trees"), imbalance="fresh", final_rounds=3)
    model = RelationalModel(options).fit(data, rows)
    scores = model.predict_other().toPandas()
    assert sorted(scores.row_id) == list(range(60)) and scores.score.between(0, 1).all()
    assert len(model.trials) == 4 and set(model.chosen) <= {t.number for t in model.trials if t.rounds > 1}
    sizes = {r["c_k"]: r["n_freq__c_k"] for r in model.other.select("c_k", "n_freq__c_k").collect()}
    assert all(abs(v - 18 / 360) < 1e-9 for v in sizes.values())  # shares of the training and test rows together


def test_double_validation_outlier_share_row_bound_and_balance(spark, folder):
    data = read_train(spark, f"{folder}/train")
    options = _with(
        double_validation=True, objectives=("loss", "agreement", "neg_f1"), drop_outliers=True, outlier_share=0.1, max_rows=200,
        imbalance="down", final_rounds=3, folds=2,
    )
    model = RelationalModel(options).fit(data)
    assert all(t.held_auc is not None and t.held_auc > 0.5 for t in model.trials)
    assert model.predict(read_test(spark, f"{folder}/test", data.config)).count() == 60
    model.drop()
    assert model.merge.sides == []


@pytest.fixture(scope="module")
def informative(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), 7.0, int(a + 0.3 * rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    return spark.createDataFrame(rows, "row_id long, n_good double, n_noise double, n_flat double, label int").cache()


NAMES = ["n_good", "n_noise", "n_flat"]


@pytest.mark.parametrize("method", ["imp", "cor", "chi", "gain", "shap", "sfm", "nh", "backward"])
def test_every_selection_method_finds_the_signal(informative, method):
    kw = {"trees": 5, "max_depth": 3} if method in ("imp", "shap", "sfm", "nh", "backward") else {}
    if method == "nh":
        kw["runs"] = 3
    got = L.select_features(informative, NAMES, method, 0.7, **kw)
    assert "n_good" in got
    if method in ("imp", "shap", "sfm", "nh"):
        assert "n_flat" not in got


def test_keep_count_rules():
    assert (L.keep_count(10), L.keep_count(10, 0.8, 50), L.keep_count(10, 0.8, 1000)) == (8, 5, 8)


def test_components_explain_the_ratio(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(2 * x + 0.01 * rng.normal()), float(rng.normal() * 0.01)) for i, x in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    one = R.Reducer.fit(df.withColumn("c", F.lit(1.0)), ["a", "b", "c"])
    assert len(one.explained) == 1 and one.transform(df).columns == ["row_id", "f_0"]
    assert len(R.Reducer.fit(df, ["a", "b", "c"], 0.9999).explained) >= 2


def test_isolation_forest_finds_far_points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))] + [(500, 30.0, 30.0), (501, -30.0, 25.0)]
    df = spark.createDataFrame(rows, "row_id long, n_a double, n_b double")
    forest = R.IsolationForest.fit(df, ["n_a", "n_b"], trees=30)
    worst = {r.row_id for r in forest.score(df).orderBy(F.desc("outlier_score")).limit(2).collect()}
    assert worst == {500, 501}
    kept = R.drop_outliers(df, ["n_a", "n_b"], trees=30)
    assert kept.filter("row_id >= 500").count() == 0 and kept.count() > 300
    kept = R.drop_outliers(df, ["n_a", "n_b"], trees=30, share=0.15)
    assert kept.columns == df.columns and kept.count() == 502 - 75 and kept.filter("row_id >= 500").count() == 0
    equal = spark.createDataFrame([(i % 3, 1.0, "x") for i in range(100)], "row_id long, n_a double, c_b string")
    assert R.drop_outliers(equal, trees=5, share=0.15).count() == 85


def test_pareto_front_equals_brute_force(spark, tiny):
    rng = np.random.default_rng(4)
    pts = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 40, size=(300, 2)))]
    df = spark.createDataFrame(pts, "i int, a int, b int")
    got = sorted(r.i for r in M.pareto_front(df, "a", "b", tiny).collect())
    want = [i for i, a, b in pts if not any(c <= a and d <= b and (c < a or d < b) for _, c, d in pts)]
    assert got == want


def test_trial_choice(spark):
    rows = [(0, -0.9, -0.01), (1, -0.8, -0.05), (2, -0.7, -0.02), (3, -0.85, -0.03), (4, -0.6, -0.06)]
    s = spark.createDataFrame(rows, "trial int, loss double, agreement double")
    assert M.select_trials(s, 2) == [0, 4]
    assert set(M.select_trials(s, 5)) == {0, 1, 2, 3, 4} and M.select_trials(s, 5)[-1] == 2
    assert M.top_trials(s, 2) == [0, 3] and M.ensemble_size(10) == 5 and M.ensemble_size(3) == 2


def test_greedy_choice_stops_where_error_is_lowest(spark):
    y = [0, 1, 0, 1]
    p = {0: [0.4, 0.9, 0.1, 0.6], 1: [0.2, 0.6, 0.3, 0.8], 2: [0.9, 0.1, 0.9, 0.1]}
    rows = [(t, i, y[i], v) for t, ps in p.items() for i, v in enumerate(ps)]
    s = spark.createDataFrame(rows, "trial int, row_id int, label int, p double")
    chosen = M.greedy_selection(s, 3)
    assert chosen[0] == 0 and 2 not in chosen
    assert M.bagging(s, [0, 1]).filter("row_id = 1").first().score == pytest.approx(0.75)


def test_a_race_drops_weak_trials_and_ends_like_the_full_run(informative):
    rows = T.prepare_trials(informative, ["n_good", "n_noise"], n_folds=2)
    candidates = [{"max_depth": 3}, {"min_gain": 9.0}, {"min_gain": 9.0, "max_depth": 2}, {"min_data_in_leaf": 140}]
    full, _ = T.cross_validate(rows, candidates, 8, 2, curves=True)
    trials, scores = T.race(rows, candidates, 8, 2, curves=True)
    best = max(full, key=lambda t: t.auc)
    assert best.number == 0 and max(trials, key=lambda t: (t.rounds, t.auc)).number == 0
    assert trials[0].auc == pytest.approx(best.auc) and trials[0].curve == pytest.approx(best.curve)
    assert [t.rounds for t in trials] == [8, 2, 2, 4] and [t.rounds for t in full] == [8] * 4
    assert len(best.curve) == 8 and best.curve[0] > best.curve[3]
    assert {r[0] for r in scores.select("trial").distinct().collect()} == {0}


def test_folds_stop_early_without_a_signal(informative):
    rows = T.prepare_trials(informative, ["n_noise", "n_flat"], n_folds=2)
    held = T.assemble(informative.filter("row_id < 50"), ["n_noise", "n_flat"])
    trials, scores = T.cross_validate(rows, [{"max_depth": 4}], 15, 2, early=True, held=held)
    assert trials[0].rounds < 15 and trials[0].held_auc is not None and scores.count() == 600


def test_trees_and_held_losses_join_the_summary(spark):
    s = spark.createDataFrame([(0, -0.9, -0.1), (1, -0.8, -0.2)], "trial int, loss double, agreement double")
    rows = M.with_held_loss(M.with_trees(s, {0: 5, 1: 9}), {0: 0.6}).orderBy("trial").collect()
    assert [(r["loss"], r["trees"], r["neg_trees"]) for r in rows] == [(-0.6, 5.0, -5.0), (-0.8, 9.0, -9.0)]


def test_bagged_score_is_the_mean_of_the_models(informative):
    rows = T.assemble(informative, NAMES)
    models = [T.train(rows, {"max_depth": d}, 3, seed=d) for d in (2, 3)]
    singles = [T.score(m, rows, "p").orderBy("row_id").toPandas().p for m in models]
    both = T.bagged_score(models, rows).orderBy("row_id").toPandas().score
    assert np.allclose(both, (singles[0] + singles[1]) / 2)


@pytest.mark.parametrize("name", ["cumulative", "row_index", "generate_default", "mv_code", "merge_tables_star", "temporal_rolling_keyed"])
def test_default_path_stays_in_the_jvm(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["row_predicates"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value)" in plan and "props" not in plan


@pytest.mark.parametrize("name,per_row", [("random_search", 2), ("stacking", 1)])
def test_search_scores_rows_outside_the_sample(spark, sf, name, per_row, monkeypatch):
    draw = T.stratified_sample
    monkeypatch.setattr(T, "stratified_sample", lambda df, rows, *a: draw(df, 300, *a))
    out = QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert n > 300 and out.select("row_id").distinct().count() == n and out.count() == per_row * n


def test_gbt_query_runs_the_whole_pipeline_on_all_rows(monkeypatch):
    from relweave.plans import catalog_models as M

    seen = []

    def stopped(options):
        seen.append(options)
        raise InterruptedError

    monkeypatch.setattr(M, "_urgent", lambda *a: type("D", (), {"main": None}))
    monkeypatch.setattr(M, "folds", lambda *a: None)
    monkeypatch.setattr(M, "RelationalModel", stopped)
    with pytest.raises(InterruptedError):
        M.gbt_fit_predict(None, "")
    # it fitted 3 rounds after 2 trials of 2 rounds and 2 folds, on at most 4 million rows
    assert seen == [ModelOptions(merge=seen[0].merge)] and seen[0].max_rows is None and seen[0].final_rounds == 300


def test_small_tables_are_dealt_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(1000).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == cores and spread(few).count() == 1000
    many = spark.range(1000).repartition(cores + 1)
    assert spread(many) is many
