"""Exact top-k by inner product: vectors in buckets of similar length, pruned by local thresholds.

A score is |q| |p| cos(q, p). In a bucket whose longest vector has length l, only vectors whose cosine
with q reaches theta / (|q| l) can enter q's list, theta being q's k-th best score so far:

* above 1, the whole bucket is skipped for q;
* where it is high, candidates must lie near q in q's largest coordinate (coordinate pruning): with angles
  a and b of q and p to its axis, |a - b| is at most the local angle, and b stays within 0 and 180 degrees;
* where it is low, the bucket's vectors of sufficient length are a prefix by length (length pruning).

What is left is verified with full products. A first pass over the longest vectors gives every query a
theta; the second pass covers all buckets. Buckets and queries are dealt in blocks of bounded size, so
a bucket with a third of all vectors is many blocks; only lists of k per query and block move on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import type_of
from relweave.session import materialize

BLOCK, QUERIES = 32_768, 4_096
GROWTH = 1.1
#: Local cosine from which coordinates prune better than lengths.
STEEP = 0.8
#: Slack of the pruning bounds for rounding: of scores, absolute and relative, and of coordinates.
_SLACK, _SHARE, _NEAR = 1e-6, 1e-9, 1e-7
_PART = 2_048


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to the smaller id.

    Scores are in double precision, exact for whole numbers below 2**53. A null vector, one with a null or non-finite number,
    an empty one and a null id take no part; vectors meet those of their own dimension only; equal ids
    are the same row's for the purpose of "other". Other columns are not read.
    """
    kind = type_of(vectors, vec_id)
    base = materialize(_packed(vectors, vec_id, vector, kind))
    asked = materialize(_packed(queries, vec_id, vector, kind))
    sizes = base.groupBy("dim", "bucket").count().collect()  # logarithms of lengths: a few thousand at most
    blocks = {(r["dim"], r["bucket"]): max(1, math.ceil(r["count"] / BLOCK)) for r in sizes}
    parts = max(1, math.ceil(asked.count() / QUERIES))
    spark = vectors.sparkSession
    n_blocks = spark.createDataFrame([(*key, n) for key, n in blocks.items()] or [(0, 0, 1)], "dim int, bucket int, n int")
    placed = base.join(F.broadcast(n_blocks), ["dim", "bucket"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).drop("bucket")
    longest: dict = {}
    for dim, bucket in blocks:
        longest[dim] = max(longest.get(dim, bucket), bucket)
    seeds = spark.createDataFrame([(d, b, 0) for d, b in longest.items()] or [(0, 0, 0)], "dim int, bucket int, block int")
    first = _search(placed.join(F.broadcast(seeds), ["dim", "bucket", "block"]), asked.withColumn("theta", F.lit(None).cast("double")), parts, n_blocks, k, kind)
    theta = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("theta"))
    theta = theta.filter(F.col("m") >= k).select(F.col("query_id").alias("id"), "theta")
    aimed = asked.join(materialize(theta), "id", "left")
    found = _search(placed, aimed, parts, n_blocks, k, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _packed(df: DataFrame, vec_id: str, vector: str, kind: str) -> DataFrame:
    """(id, dim, bucket, length, x): usable vectors as packed doubles, and their bucket of length."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.col(vec_id).isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(vec_id), x.alias("x")).filter(F.col("x").isNotNull() & good).select(F.col(vec_id).alias("id"), "x")

    def pack(batches):
        for batch in batches:
            vs = [np.array(v) for v in batch["x"].to_pylist()]
            length = [float(np.sqrt(v @ v)) for v in vs]
            bucket = [math.floor(math.log(n, GROWTH)) if n > 0 else -10_000 for n in length]
            columns = {"id": batch["id"], "dim": pa.array([len(v) for v in vs], pa.int32()), "bucket": pa.array(bucket, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | {"length": pa.array(length, pa.float64()), "x": pa.array([v.tobytes() for v in vs], pa.binary())})

    return rows.mapInArrow(pack, f"id {kind}, dim int, bucket int, length double, x binary")


def _search(placed: DataFrame, asked: DataFrame, parts: int, n_blocks: DataFrame, k: int, kind: str) -> DataFrame:
    """Every block's lists for every part of the queries."""
    keys = ["dim", "bucket", "block", "part"]
    rows = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cells = n_blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    spread = asked.join(F.broadcast(cells), "dim")

    def cell(key, found: pa.Table, base: pa.Table) -> pa.Table:
        return _cell(found, base, k)

    return spread.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(cell, f"query_id {kind}, vec_id {kind}, score double")


def _matrix(table: pa.Table) -> np.ndarray:
    raw = table["x"].to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _cell(queries: pa.Table, base: pa.Table, k: int) -> pa.Table:
    ids_type = base["id"].type if base.num_rows else queries["id"].type
    if not queries.num_rows or not base.num_rows:
        return pa.table({"query_id": pa.array([], ids_type), "vec_id": pa.array([], ids_type), "score": pa.array([], pa.float64())})
    base = base.take(pa.array(np.lexsort((base["id"].to_numpy(), -base["length"].to_numpy()))))
    q, p = _matrix(queries), _matrix(base)
    q_id, p_id = queries["id"].to_numpy(), base["id"].to_numpy()
    length = base["length"].to_numpy()
    norm = np.maximum(np.sqrt((q * q).sum(1)), 1e-300)
    theta = np.array([-np.inf if v is None else v for v in queries["theta"].to_pylist()])
    got: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    focus = np.abs(q).argmax(1)
    for at in range(0, len(p), _PART):
        rows, ls = p[at : at + _PART], length[at : at + _PART]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.nan_to_num(_least(theta) / (norm * ls[0]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        live = np.flatnonzero(local <= 1)
        near = local[live] >= STEEP
        for i in live[near].tolist():  # coordinate pruning, query by query
            unit, t = q[i, focus[i]] / norm[i], min(local[i], 1.0)
            reach = math.sqrt(max(0.0, (1 - t * t) * (1 - unit * unit))) + _NEAR
            # past an end of the axis the bound would turn back: there is none
            low = unit * t - reach if unit > _NEAR - t else -np.inf
            high = unit * t + reach if unit < t - _NEAR else np.inf
            c = rows[:, focus[i]] / np.maximum(ls, 1e-300)
            some = np.flatnonzero((c >= low) & (c <= high) & (ls * norm[i] >= _least(theta[i])))
            some = some[(rows[some] @ q[i] >= _least(theta[i])) & (p_id[at + some] != q_id[i])]
            got = [np.concatenate([a, b]) for a, b in zip(got, (np.full(len(some), i), at + some, rows[some] @ q[i]))]
        wide = live[~near]
        if len(wide):
            need = _least(theta[wide].min()) / norm[wide].max() if theta[wide].min() > 0 else -np.inf
            n = int(np.searchsorted(-ls, -need, "right"))  # length pruning: a prefix
            scores = q[wide] @ rows[:n].T
            scores[p_id[at : at + n][None, :] == q_id[wide][:, None]] = -np.inf
            if n > k:
                theta[wide] = np.maximum(theta[wide], np.partition(scores, n - k, 1)[:, n - k])
            a, b = np.nonzero((scores >= _least(theta[wide])[:, None]) & np.isfinite(scores))
            got = [np.concatenate([x, y]) for x, y in zip(got, (wide[a], at + b, scores[a, b]))]
        got, theta = _best(got, theta, p_id, k)
    return pa.table({"query_id": pa.array(q_id[got[0]], ids_type), "vec_id": pa.array(p_id[got[1]], ids_type), "score": pa.array(got[2], pa.float64())})


def _least(theta):
    """What a score's upper bound has to reach."""
    return theta - _SLACK - _SHARE * np.abs(theta)


def _best(got: list[np.ndarray], theta: np.ndarray, p_id: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The k best of each query so far, and the raised thresholds."""
    order = np.lexsort((p_id[got[1]], -got[2], got[0]))
    who = got[0][order]
    start = np.searchsorted(who, who)
    rank = np.arange(len(who)) - start
    kept = order[rank < k]
    last = order[rank == k - 1]
    theta = theta.copy()
    theta[got[0][last]] = np.maximum(theta[got[0][last]], got[2][last])
    return [a[kept] for a in got], theta
