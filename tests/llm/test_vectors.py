"""Nearest neighbours and hard negatives against brute force, on awkward vectors and on the given ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave.llm import hardneg, lsh
from relweave.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("id", "x", "dim", "cell", "n", "rank", "score", "r", "block")})


def awkward(seed: int, whole: bool):
    """Vectors of two dimensions and many lengths, copies, ties, repeated rows, and rows that take no part."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        v = draw.standard_normal(3 if i % 9 == 4 else 6) * 3.0 ** draw.integers(-2, 3)
        rows.append([i, (np.floor(8 * v) if whole else v).tolist(), int(draw.integers(0, 4))])
    hot = [1.0, 2.0, 0.0, 0.0, -1.0, 3.0]
    rows += [[400 + i, hot, i % 2] for i in range(60)]
    rows += [rows[20], rows[20], [20, rows[40][1], 1], [500, None, 1], [501, [], 1], [502, [1.0, None] * 3, 1], [503, [NAN] * 6, 1]]
    rows += [[504, [INF] * 6, 1], [None, hot, 1], [505, [-1.0] * 6, None], [507, [0.5], 2], [600, [3.0, 4.0, 5.0], 7]]
    return [tuple(r) for r in rows]


def usable(rows):
    return [(i, v, c) for i, v, c in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]


def dot(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


# --------------------------------------------------------------------------- neighbours


def by_brute_force(rows, every, k):
    seen = {(i, tuple(v)) for i, v, _ in usable(rows) if any(v)}
    asks = {}
    for i, v in seen:
        if i % every == 0:
            asks.setdefault(i, []).append(v)
    out = {}
    for i, vs in asks.items():
        q = min(vs, key=lambda v: (len(v), np.array(v).tobytes()))
        found = sorted((-dot(q, v), j) for j, v in seen if len(v) == len(q) and j != i)[:k]
        out[i] = [(j, -s) for s, j in found]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def shared(got, want):
    """The share of the wanted rows that were found; a row with the score of a wanted one counts for it."""
    hits = sum(sum(s >= rows[-1][1] for _, s in got.get(i, [])) for i, rows in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("k", [1, 5, 30])
def test_neighbours_on_awkward_vectors(spark, k):
    rows = awkward(k, False)
    df = frame(spark, rows)
    got, want = listed(lsh.nearest(df, df.filter(F.col("vec_id") % 10 == 0), k)), by_brute_force(rows, 10, k)
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items() if v}
    assert shared(got, want) >= 0.9
    exact = {i: dict(by_brute_force(rows, 10, 1_000)[i]) for i in got}
    assert all(exact[i][j] == s for i, found in got.items() for j, s in found)
    assert all(found == sorted(found, key=lambda f: (-f[1], f[0])) for found in got.values())


def test_neighbours_equal_brute_force_where_all_buckets_are_visited(spark, monkeypatch):
    rows = awkward(3, False)
    df = frame(spark, rows)
    monkeypatch.setattr(lsh, "_visits", lambda *a: None)
    for size in (lsh.SMALL, 16):
        monkeypatch.setattr(lsh, "SMALL", size)
        got = listed(lsh.nearest(df, df.filter(F.col("vec_id") % 10 == 0), 7))
        assert got == {i: v for i, v in by_brute_force(rows, 10, 7).items() if v}


def test_cells_are_cut(spark, monkeypatch):
    rows = [(i, (np.random.default_rng(i).standard_normal(6) + (9 if i % 3 else 0)).tolist(), 0) for i in range(900)]
    monkeypatch.setattr(lsh, "SMALL", 64)
    monkeypatch.setattr(lsh, "BUCKET", 8)
    df = frame(spark, rows)
    got, want = listed(lsh.nearest(df, df.filter(F.col("vec_id") % 10 == 0), 10)), by_brute_force(rows, 10, 10)
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items()} and shared(got, want) >= 0.9


def test_visits_follow_the_estimated_success():
    index = lsh.Index(1.0, 3, 5)
    assert index.of_cell == 3
    index.of_cell = 1
    q = np.random.default_rng(0).standard_normal((5, 8))
    q /= np.linalg.norm(q, axis=1)[:, None]
    place = index._places(q, 0, True)
    down = place - np.floor(place)
    mix = lsh._drawn(8, 3, 0)[2]
    cell, bucket = index.visited(q, 0, 27, True)
    assert bucket.shape == (5, 27)
    for i in range(5):
        every = []
        for move in np.ndindex(3, 3, 3):
            step = np.array(move) - 1
            cost = sum(0 if s == 0 else (down[i, j] if s < 0 else 1 - down[i, j]) ** 2 for j, s in enumerate(step))
            at = (np.floor(place[i]).astype(np.int64) + step) * mix
            every.append((cost, (int(at[0]) >> 20) % 5, int(lsh._number(at.sum()[None])[0])))
        every.sort()
        assert [x[1:] for x in every] == list(zip(cell[i].tolist(), bucket[i].tolist()))


def test_neighbours_of_empty_tables(spark):
    df = frame(spark, awkward(0, False))
    none = df.limit(0)
    assert lsh.nearest(none, none).count() == lsh.nearest(df, none).count() == lsh.nearest(none, df).count() == 0
    alone = frame(spark, [(1, [1.0, 2.0], 0), (2, [0.0, 0.0], 0)])
    assert lsh.nearest(alone, alone).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_recall_of_the_query(spark, size):
    folder = f"/root/testdata/sf{size}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    asks = np.flatnonzero(ids % 20 == 0)
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -np.inf
    got = listed(QUERIES["op11_multiprobe_hashing"](spark, folder))
    assert sorted(got) == sorted(ids[asks].tolist()) and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[i]} & set(ids[np.argsort(-s)[:20]].tolist())) for i, s in zip(ids[asks].tolist(), score))
    assert hits >= 0.9 * 20 * len(asks)


# ------------------------------------------------------------------------ hard negatives


@pytest.mark.parametrize("columns,size", [(6, 30), (2_000, 5), (40, 10**7), (9, 2 * 10**8)])
def test_products_are_exact(columns, size):
    draw = np.random.default_rng(columns)
    a, b = (np.floor(draw.standard_normal((7, columns)) * size) for _ in "ab")
    a[0], b[0] = -size * 3, size * 3
    bound = int(max((a * a).sum(1).max(), (b * b).sum(1).max()) * (1 + 1e-9)) + 1
    primes = hardneg.primes_for(bound)
    got = hardneg.products(hardneg.residues(a, primes), hardneg.residues(b, primes), primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]


def mined(rows, every, positives, most, window):
    rows = [r for r in usable(rows) if r[2] is not None]
    asks = {}
    for i, v, c in rows:
        if i % every == 0:
            asks.setdefault(i, []).append((c, len(v), v))
    out = []
    for i, own in asks.items():
        own.sort(key=lambda r: r[:2])
        c, _, q = own[0]
        near = [(-int(dot(q, v)), j, d) for j, v, d in rows if j != i and len(v) == len(q)]
        good = sorted(x[:2] for x in near if x[2] == c)[:positives]
        for s, j in good:
            hard = sorted(x[:2] for x in near if x[2] != c and window[0] * -s <= 100 * -x[0] <= window[1] * -s)[:most]
            out += [(i, j, k + 1, h, -s, -t) for k, (t, h) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed):
    rows = awkward(seed, True)
    df = frame(spark, rows)
    want = mined(rows, 10, 5, 10, (30, 90))
    assert want and any(r[4] < 500 for r in want)
    assert sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 10 == 0).collect()) == want
    monkeypatch.setattr(hardneg, "BLOCK", 20)
    monkeypatch.setattr(hardneg, "PART", 15)
    monkeypatch.setattr(hardneg, "SEED", 4)
    monkeypatch.setattr(hardneg, "_TALL", 4)
    monkeypatch.setattr(hardneg, "_WIDE", 9)
    assert sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 10 == 0).collect()) == want
    wide = mined(rows, 10, 2, 4, (-50, 200))
    assert sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 10 == 0, 2, 4, (-50, 200)).collect()) == wide


def test_hard_negatives_of_empty_tables_and_long_vectors(spark):
    df = frame(spark, awkward(0, True))
    asks = F.col("vec_id") % 10 == 0
    assert hardneg.mine(df.limit(0), asks).count() == hardneg.mine(df, F.lit(False)).count() == 0
    with pytest.raises(ValueError, match="62 bits"):
        hardneg.mine(frame(spark, [(1, [1e300, 1.0], 0)]), asks)
