import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from relweave import Scale
from relweave.functions import rolling as frames
from relweave.functions.ordered import Scan, key_sizes, lag, prefix_scan, row_index
from relweave.functions.rolling import rolling
from relweave.operators.generate import cumulative_features


@pytest.fixture(scope="module")
def frame(spark):
    """600 rows: one key and one timestamp hold a third each; some values and keys are null."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 40}")
        t = 0 if rng.random() < 0.33 else rng.randrange(1000)
        rows.append((i, key, t, None if i % 7 == 0 else float(rng.randrange(1, 90))))
    pdf = pd.DataFrame(rows, columns=["id", "k", "t", "v"])
    return spark.createDataFrame(rows, "id long, k string, t long, v double"), pdf.sort_values(["t", "id"])


def _same(got, want):
    got = got.sort_values("id").reset_index(drop=True)
    want = want.sort_values("id").reset_index(drop=True)[list(got.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_hot_keys_are_listed_exactly(frame, tiny):
    sizes = key_sizes(frame[0], ["k"], tiny)
    assert [r[0] for r in sizes.hot.collect()] == ["hot"]
    assert (sizes.rows, sizes.hot_rows, sizes.null_rows) == (600, 200, 8)


def test_global_scan_equals_pandas(frame, tiny):
    df, pdf = frame
    v = F.col("v")
    got = prefix_scan(
        df,
        ["t", "id"],
        {
            "s": Scan("sum", v),
            "m": Scan("mean", v),
            "hi": Scan("max", v),
            "lo": Scan("min", v),
            "i": Scan("index"),
            "n": Scan("count", v, skip_null=False),
        },
        scale=tiny,
    ).toPandas()
    want = pdf.copy()
    pos = pd.Series(range(1, 601), index=want.index)
    want["s"], want["m"] = want.v.cumsum(), want.v.cumsum() / pos
    want["hi"], want["lo"], want["i"] = want.v.cummax(), want.v.cummin(), pos
    want["n"] = want.v.notna().cumsum()
    _same(got, want)


def test_keyed_scan_with_hot_key_equals_plain_window(frame, tiny):
    df, _ = frame
    scans = {"s": Scan("sum", F.col("v")), "e": Scan("sum", F.col("v"), inclusive=False, skip_null=False)}
    scans["l"] = Scan("last", F.col("v"), inclusive=False)
    a = prefix_scan(df, ["t", "id"], scans, ["k"], tiny).toPandas()
    b = prefix_scan(df, ["t", "id"], scans, ["k"]).toPandas()
    _same(a, b)
    assert a[a.k.isna()].s.isna().all()


def test_row_index_and_lag(frame, tiny):
    df, pdf = frame
    got = lag(row_index(df, ["t", "id"], "i", scale=tiny), ["t", "id"], {"p": "v"}, scale=tiny).toPandas()
    want = pdf.copy()
    want["i"], want["p"] = range(600), want.v.shift(1)
    _same(got, want)


@pytest.mark.parametrize("window,need,widest", [(3, 3, 64), (5, 1, 2), (20, 2, 64), (37, 30, 8), (900, 1, 8)])
def test_rolling_equals_pandas(frame, tiny, monkeypatch, window, need, widest):
    monkeypatch.setattr(frames, "FRAME", widest)
    df, pdf = frame
    fns = ["mean", "sum", "std", "median", "min", "max"]
    aggs = {f: (f, "v") for f in fns} | {"count": ("count", "v")}
    for key in [[], ["k"]]:
        got = rolling(df, ["t", "id"], window, aggs, key, need, tiny).toPandas()
        want = pdf.copy() if not key else pdf[pdf.k.notna()].copy()
        groups = want if not key else want.groupby("k", group_keys=False)
        for f in fns:
            roll = groups["v"].rolling(window, min_periods=need)
            r = getattr(roll, f)()
            want[f] = r if not key else r.reset_index(0, drop=True)
        got = got if not key else got[got.k.notna()]
        want["count"] = got.set_index("id")["count"].reindex(want.id).values
        _same(got, want)


def test_wide_count(frame, tiny):
    df, pdf = frame
    got = rolling(df, ["t", "id"], 100, {"n": ("count", "k")}, scale=tiny).toPandas()
    want = pdf.copy()
    want["n"] = want.k.notna().rolling(100, min_periods=1).sum()
    _same(got, want)


ALL = {f: (f, "v") for f in ["mean", "sum", "std", "median", "min", "max", "count"]}


@pytest.mark.parametrize("window,key", [(65, ["k"]), (257, [])])
def test_wide_frames_do_not_depend_on_the_limits(spark, window, key):
    rows = [(i, f"k{i % 2}", None if i % 11 == 0 else math.sin(i * i) * 10.0 ** (i % 9 - 4)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(7)
    got = [sorted(rolling(df, ["id"], window, ALL, key, 1, scale).collect()) for scale in (Scale(), Scale(block_rows=90, broadcast_rows=10))]
    assert got[0] == got[1]
    lists = {}
    for r in got[0]:
        seen = lists.setdefault(r["k"] if key else 0, [])
        seen.append(r["v"])
        here = [v for v in seen[-window:] if v is not None]
        assert r["count"] == len(here)
        assert (r["median"], r["min"], r["max"]) == ((statistics.median(here), min(here), max(here)) if here else (None,) * 3)
        assert r["sum"] == (pytest.approx(math.fsum(here), abs=1e-9) if here else None)
        assert r["std"] == (pytest.approx(statistics.stdev(here), rel=1e-9) if len(here) > 1 else None)


def test_wide_deviation_far_from_zero_and_nan(spark):
    rows = [(i, 1e9 + i % 5, float("nan") if i == 50 else -0.0 if i % 3 else 5.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, w double")
    got = rolling(df, ["id"], 100, {"std": ("std", "v"), "hi": ("max", "w"), "mid": ("median", "w"), "s": ("sum", "w")}, (), 1)
    got = got.orderBy("id").collect()
    for i in (99, 250, 399):
        assert got[i]["std"] == pytest.approx(statistics.stdev(1e9 + j % 5 for j in range(i - 99, i + 1)), rel=1e-8)
    assert all(math.isnan(got[i]["hi"]) and math.isnan(got[i]["s"]) for i in (50, 149))
    assert got[49]["hi"] == got[150]["hi"] == 5.0 and got[150]["mid"] == 0.0 and not math.isnan(got[150]["s"])


def test_wide_medians_of_rising_and_equal_values(spark):
    kinds = {"up": float, "one": lambda i: 7.0, "down": lambda i: float(-i // 90), "late": lambda i: float(i % 2) if i > 350 else None}
    rows = [(i, k, f(i)) for k, f in kinds.items() for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    found = rolling(df, ["id"], 130, {"m": ("median", "v")}, ["k"], 1, Scale(block_rows=200, broadcast_rows=10))
    got = {(r["k"], r["id"]): r["m"] for r in found.collect()}
    for k, f in kinds.items():
        for i in range(800):
            here = [v for v in map(f, range(max(0, i - 129), i + 1)) if v is not None]
            assert got[k, i] == (statistics.median(here) if here else None)


def test_wide_frames_of_no_rows_and_null_keys(frame, tiny):
    df, _ = frame
    assert rolling(df.limit(0), ["t", "id"], 100, ALL, (), 1, tiny).count() == 0
    got = rolling(df, ["t", "id"], 100, ALL, ["k"], 1, tiny)
    assert got.count() == 600 and got.filter("k is null and (count is not null or median is not null)").count() == 0


def test_wide_plans_have_no_python_and_no_large_groups(frame, tiny):
    plan = rolling(frame[0], ["t", "id"], 500, ALL, (), 1, tiny)._jdf.queryExecution().toString()
    body = plan.split("== Physical Plan ==")[1]
    assert "Python" not in body and "Pandas" not in body and "Arrow" not in body
    assert body.count("SinglePartition") <= 2  # the number of the last block


def test_global_plans_have_no_single_partition_over_rows(frame, tiny):
    plan = row_index(frame[0], ["t", "id"], scale=tiny)._jdf.queryExecution().toString()
    body = plan.split("== Physical Plan ==")[1]
    assert body.count("SinglePartition") <= 1  # the per-block totals only


def test_scans_of_one_column_share_their_running_values(spark, capsys):
    df = spark.createDataFrame([(i, float(i % 5) if i % 3 else None) for i in range(50)], "row_id long, n_x double")
    out = cumulative_features(df, ["n_x"])
    out.explain(True)
    logical = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert logical.count("windowspecdefinition") == 4  # sum, rows, max, min
    n = total = 0
    for r in out.orderBy("row_id").collect():
        n, total = n + 1, total + (r.n_x or 0.0)
        want = (total, total / n) if r.n_x is not None else (None, None)
        assert (r.n_cumsum__n_x, r.n_cummean__n_x) == want
