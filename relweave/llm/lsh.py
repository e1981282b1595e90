"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

A hash of a vector v is floor(a.v / w + b) with normal a; a bucket is a tuple of hashes, and every table has
its own. Inner products become distances by one more coordinate: with M the greatest length, a row p is
hashed as (p, sqrt(M^2 - |p|^2)) and a query q as (M q / |q|, 0), so nearer means a larger product.

A query visits its own bucket and those reached by moving some hashes by one, in the order of estimated
success: the least sum of squared distances to the bounds that are crossed. The sets of moves come from
one list, made for the expected distances; each query orders it by its own. How many buckets are visited
is fitted: for a bounded sample of queries all rows are searched exactly, and the number is the
least that finds the wanted share of their neighbours. Where no number does, or a query finds fewer rows
than it asks for, its whole dimension is searched, in blocks.

Rows lie in cells, of buckets that agree in their first hashes; a cell with many rows is cut into blocks of
bounded size. A query is sent once to every cell it visits, with its buckets there; products are taken in
double precision for the rows of those buckets only, and lists of k move on.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.session import materialize

#: Tables, bits of a hash, its width in lengths, rows in a bucket that the number of hashes aims at.
TABLES, BITS, WIDTH, BUCKET = 2, 1.05, 2.0, 128
#: Sets of moves in the list, queries of the fit and the share of their neighbours it has to find.
MOVES, SAMPLE, WANTED = 4_096, 256, 0.95
#: Rows in a block of a cell: at most, and at least where cores would idle.
CELL, SMALL, MAX_HOT = 65_536, 4_096, 100_000
_TALL, _NEAR = 256, 1e-9


# ------------------------------------------------------------------------------ hashing


@functools.lru_cache(maxsize=4)
def moves(hashes: int, most: int = MOVES) -> np.ndarray:
    """(set, position): which of the 2 x ``hashes`` nearest bounds a set crosses, sets in order of expected cost."""
    k = hashes
    z = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    z += [1 - j / (k + 1) + j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(k, 0, -1)]
    found, heap = [()], [(z[0], (0,))] if k else []
    while heap and len(found) < most:
        cost, chosen = heapq.heappop(heap)
        if not any(2 * k - 1 - j in chosen for j in chosen):  # never both bounds of a hash
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(found), 2 * k), bool)
    for i, chosen in enumerate(found):
        out[i, list(chosen)] = True
    return out


@functools.lru_cache(maxsize=64)
def _drawn(dim: int, hashes: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng([dim, hashes, table])
    mix = draw.integers(1 << 40, 1 << 62, hashes) * 2 + 1
    return draw.standard_normal((dim + 1, hashes)), draw.uniform(0, 1, hashes), mix


class Index:
    """The numbers that fix all hashes: greatest length, hashes of a bucket, cells, buckets to visit."""

    def __init__(self, length: float, hashes: int, cells: int, visits: int | None = None):
        self.length, self.hashes, self.cells, self.visits = length, hashes, cells, visits
        # about as many different beginnings of buckets as make the likeliest of them a small part of a cell
        self.of_cell = min(hashes, math.ceil(2 * math.log2(cells) / BITS)) if cells > 1 else 0

    def _cell(self, begins: np.ndarray) -> np.ndarray:
        return (begins >> 20) % self.cells

    def _places(self, x: np.ndarray, table: int, asks: bool) -> np.ndarray:
        a, b, _ = _drawn(x.shape[1], self.hashes, table)
        size = np.sqrt((x * x).sum(1))
        if asks:
            x, rest = x * (self.length / size)[:, None], np.zeros(len(x))
        else:
            rest = np.sqrt(np.maximum(self.length**2 - size**2, 0))
        return (x @ a[:-1] + rest[:, None] * a[-1]) / (WIDTH * self.length) + b

    def buckets(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, bucket) of rows; two buckets may share a number, which only adds candidates."""
        mix = _drawn(x.shape[1], self.hashes, table)[2]
        at = np.floor(self._places(x, table, False)).astype(np.int64) * mix
        return self._cell(at[:, : self.of_cell].sum(1)), _number(at.sum(1))

    def visited(self, x: np.ndarray, table: int, most: int, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, visit): the cells and buckets that queries visit first, in that order if asked for."""
        k, mix = self.hashes, _drawn(x.shape[1], self.hashes, table)[2]
        place = self._places(x, table, True)
        home = np.floor(place)
        down = place - home
        crossed = np.concatenate([down, 1 - down], 1) ** 2
        order = np.argsort(crossed, 1, kind="stable")
        sets = moves(k).astype(float).T
        cost = np.take_along_axis(crossed, order, 1) @ sets
        if ordered or most >= sets.shape[1]:
            first = np.argsort(cost, 1, kind="stable")[:, :most]
        else:
            first = np.argpartition(cost, most - 1, 1)[:, :most]
        step = np.where(order < k, -1, 1) * mix[order % k]
        at = home.astype(np.int64) * mix
        bucket = at.sum(1)[:, None] + np.take_along_axis(_summed(step, sets), first, 1)
        begins = np.take_along_axis(_summed(np.where(order % k < self.of_cell, step, 0), sets), first, 1)
        return self._cell(at[:, : self.of_cell].sum(1)[:, None] + begins), _number(bucket)


def _number(bucket: np.ndarray) -> np.ndarray:
    return (bucket >> 24).astype(np.int32)


def _summed(step: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """The sum of the steps of each set, modulo 2**64, by exact products of halves."""
    low, high = step & 0xFFFFFFFF, step >> 32
    return (low.astype(float) @ sets).astype(np.int64) + ((high.astype(float) @ sets).astype(np.int64) << 32)


def _matrix(table) -> np.ndarray:
    raw = table["x"].to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def _by_dim(batch: pa.RecordBatch):
    """The rows of a batch, those of one dimension at a time."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


# -------------------------------------------------------------------------------- search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows found, ties to the smaller id.

    Scores are inner products in double precision, summed from the first number on. A null, empty or zero
    vector, one with a null or non-finite number, and a null id take no part; vectors meet those of their
    own dimension only. Ids are whole numbers; rows of an equal id are not "other" rows of each other,
    rows that repeat id and vector count once, and an id with several vectors asks with the least of them.
    Of equal vectors only the k + 1 smallest ids can be in a list, so only they are searched. Every query
    gets k rows if its dimension has as many others. Other columns are not read.
    """
    base = _packed(vectors, vec_id, vector).dropDuplicates(["id", "x"])
    twin = Window.partitionBy("x").orderBy("id")
    base = materialize(_dealt(base.withColumn("twin", F.dense_rank().over(twin)).filter(F.col("twin") <= k + 1).drop("twin")))
    once = Window.partitionBy("id").orderBy("dim", "x")
    asked = _packed(queries, vec_id, vector).withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")
    asked = materialize(asked)
    rows, length = base.agg(F.count(F.lit(1)), F.max("length")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    size = max(SMALL, min(CELL, (rows or 0) // (2 * cores)))
    bits = math.log2(max(1, (rows or 1) / BUCKET)) / BITS
    index = Index(length or 1.0, max(1, math.ceil(bits)), max(1, math.ceil((rows or 1) / size)))
    index.visits = _visits(index, base, asked, k)
    found = materialize(_search(index, base, asked, k, size, rows or 0))
    full = found.filter(F.size("found") >= k).select("id")
    short = asked.join(full, "id", "left_anti")
    if index.visits is not None and not short.isEmpty():
        short = materialize(short)
        whole = Index(index.length, index.hashes, 1)
        found = found.filter(F.size("found") >= k).unionByName(_search(whole, base, short, k, size, rows))
    listed = found.select(F.col("id").alias("query_id"), F.posexplode("found").alias("rank", "f"))
    return listed.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.down")).alias("score"))


def _packed(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, dim, length, x): usable vectors as packed doubles."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.filter((F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0))

    def pack(batches):
        for batch in batches:
            vs = [np.array(v) + 0.0 for v in batch["x"].to_pylist()]  # no negative zeros
            columns = [batch["id"], pa.array([len(v) for v in vs], pa.int32()), pa.array([float(np.sqrt(v @ v)) for v in vs], pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in vs], pa.binary())], ["id", "dim", "length", "x"])

    return rows.mapInArrow(pack, "id long, dim int, length double, x binary")


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows with a number that deals those of a cell over its blocks."""

    def number(batches):
        at = TaskContext.get().partitionId() * 7_919
        for batch in batches:
            yield batch.append_column("deal", pa.array((at + np.arange(batch.num_rows)) % (1 << 40), pa.int64()))
            at += batch.num_rows

    return rows.mapInArrow(number, "id long, dim int, length double, x binary, deal long")


def _visits(index: Index, base: DataFrame, asked: DataFrame, k: int) -> int | None:
    """Buckets to visit in each table, from a sample of the queries that is searched exactly; None: all."""
    drawn = asked.sort(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in drawn}:
        rows = [r for r in drawn if r["dim"] == dim]
        by_dim[dim] = np.array([r["id"] for r in rows]), np.stack([np.frombuffer(r["x"], np.float64) for r in rows])

    def search(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                if dim in by_dim:
                    ids, q = by_dim[dim]
                    old_id, old_x, old = best.get(dim, (np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, dim)), np.zeros((len(q), 0))))
                    x, own = _matrix(part), part["id"].to_numpy()
                    score = np.where(own[None, :] == ids[:, None], -np.inf, q @ x.T)
                    some = np.argpartition(-score, k - 1, 1)[:, :k] if len(own) > k else np.argsort(-score, 1)
                    all_id = np.concatenate([old_id, own[some]], 1)
                    all_x = np.concatenate([old_x, x[some]], 1)
                    every = np.concatenate([old, np.take_along_axis(score, some, 1)], 1)
                    first = np.argsort(-every, 1, kind="stable")[:, :k]
                    best[dim] = np.take_along_axis(all_id, first, 1), np.take_along_axis(all_x, first[:, :, None], 1), np.take_along_axis(every, first, 1)
        for dim, (_, near, score) in best.items():
            ids, q = by_dim[dim]
            visit = np.full(score.shape, -1)
            for t in range(TABLES):
                way = index.visited(q, t, MOVES, True)[1]
                for i in range(len(q)):
                    hit = way[i][None, :] == index.buckets(near[i], t)[1][:, None]
                    at = np.where(hit.any(1), hit.argmax(1), MOVES)
                    visit[i] = at if t == 0 else np.minimum(visit[i], at)
            i, j = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(score[i, j]), pa.array(visit[i, j].astype(np.int32))], ["id", "score", "visit"])

    found = base.mapInArrow(search, "id long, score double, visit int")
    order = Window.partitionBy("id").orderBy(F.desc("score"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # SAMPLE x k rows
    at = sorted(r["visit"] for r in found.select("visit").collect())
    last = at[math.ceil(WANTED * len(at)) - 1] if at else 0
    return last + 1 if last < MOVES else None


def _search(index: Index, base: DataFrame, asked: DataFrame, k: int, size: int, rows: int) -> DataFrame:
    """(id, found): every query's list, the best first, as (down, vec_id) with the negative score."""
    tables = TABLES if index.visits is not None else 1
    schema = "dim int, tab int, cell long, sub int, id long, x binary, "

    def placed(part: pa.RecordBatch, t: int) -> tuple[np.ndarray, np.ndarray]:
        if index.visits is None:
            return np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int32)
        return index.buckets(_matrix(part), t)

    def cells(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                for t in range(tables):
                    cell, n = np.unique(placed(part, t)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * len(n), pa.int32()), pa.array([t] * len(n), pa.int32()), pa.array(cell), pa.array(n)], ["dim", "tab", "cell", "n"])

    counted = base.mapInArrow(cells, "dim int, tab int, cell long, n long").groupBy("dim", "tab", "cell").agg(F.sum("n").alias("n"))
    limit = max(size, tables * rows // MAX_HOT)
    hot = {(r["dim"], r["tab"], r["cell"]): -(-r["n"] // limit) for r in counted.filter(F.col("n") > limit).collect()}  # at most MAX_HOT

    def deal(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                for t in range(tables):
                    cell, bucket = placed(part, t)
                    blocks = np.array([hot.get((dim, t, c), 1) for c in cell.tolist()], np.int64)
                    sub = (part["deal"].to_numpy() % blocks).astype(np.int32)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [part["dim"], pa.array([t] * n, pa.int32()), pa.array(cell), pa.array(sub), part["id"], part["x"], pa.array(bucket)],
                        ["dim", "tab", "cell", "sub", "id", "x", "bucket"],
                    )

    def ask(batches):
        for batch in batches:
            for dim, whole in _by_dim(batch):
                for at in range(0, whole.num_rows, _TALL):
                    part = whole.slice(at, _TALL)
                    for t in range(tables):
                        yield _asked(part, dim, t)

    def _asked(part: pa.RecordBatch, dim: int, t: int) -> pa.RecordBatch:
        n, out = part.num_rows, []
        if index.visits is None:
            cell, bucket = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int32)
        else:
            cell, bucket = index.visited(_matrix(part), t, index.visits)
        order = np.argsort(cell, 1, kind="stable")
        cell, bucket = np.take_along_axis(cell, order, 1), np.take_along_axis(bucket, order, 1)
        for i in range(n):
            cuts = np.flatnonzero(np.diff(cell[i], prepend=cell[i, 0] - 1))
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), cell.shape[1]]):
                c = int(cell[i, start])
                codes = bucket[i, start:end].tobytes()
                out += [(i, c, s, codes) for s in range(hot.get((dim, t, c), 1))]
        who = pa.array([o[0] for o in out], pa.int64())
        columns = [part["dim"].take(who), pa.array([t] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32())]
        return pa.RecordBatch.from_arrays(
            [*columns, part["id"].take(who), part["x"].take(who), pa.array([o[3] for o in out], pa.binary())],
            ["dim", "tab", "cell", "sub", "id", "x", "codes"],
        )

    keys = ["dim", "tab", "cell", "sub"]
    right = base.mapInArrow(deal, schema + "bucket int").groupBy(*keys)
    left = asked.mapInArrow(ask, schema + "codes binary").groupBy(*keys)
    kind = "array<struct<down: double, vec_id: long>>"
    lists = left.cogroup(right).applyInArrow(lambda a, b: _cell(a, b, k), f"id long, found {kind}")
    every = F.sort_array(F.flatten(F.collect_list("found")))  # k a visited cell; a row is in one cell of a table
    return lists.groupBy("id").agg(F.slice(F.array_distinct(F.slice(every, 1, tables * k)), 1, k).alias("found"))


def _cell(queries: pa.Table, base: pa.Table, k: int) -> pa.Table:
    """The lists of the queries that visit a block, from the rows of the buckets they visit."""
    kind = pa.list_(pa.struct([("down", pa.float64()), ("vec_id", pa.int64())]))
    if not queries.num_rows or not base.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], kind)], ["id", "found"])
    bucket = base["bucket"].to_numpy()
    order = np.lexsort((base["id"].to_numpy(), bucket))
    p, p_id, bucket = _matrix(base)[order], base["id"].to_numpy()[order], bucket[order]
    known, start = np.unique(bucket, return_index=True)
    end = np.append(start[1:], len(bucket))
    size = np.sqrt((p * p).sum(1)).max()
    q_id, found, ids = queries["id"].to_numpy(), [], []
    for at in range(0, queries.num_rows, _TALL):
        part = queries.slice(at, _TALL)
        q, codes = _matrix(part), part["codes"].to_pylist()
        who = np.repeat(np.arange(len(q)), [len(c) // 4 for c in codes])
        code = np.frombuffer(b"".join(codes), np.int32)
        place = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[place] == code
        pairs = np.unique(place[hit] * len(q) + who[hit])
        place, who = pairs // len(q), pairs % len(q)
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        score = np.full((len(q), len(p)), -np.inf)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)]):
            i, j, w = start[place[a]], end[place[a]], who[a:b]
            score[w, i:j] = q[w] @ p[i:j].T
        score[p_id[None, :] == q_id[at : at + len(q)][:, None]] = -np.inf
        near, slack = [], _NEAR * size * np.sqrt((q * q).sum(1))
        for i, row in enumerate(score):
            least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            near.append(np.flatnonzero((row >= least - slack[i]) & (row > -np.inf)))
        who, some = np.repeat(np.arange(len(q)), list(map(len, near))), np.concatenate(near)
        exact = _product(q[who], p[some])
        order = np.lexsort((p_id[some], -exact, who))
        begin = np.searchsorted(who, np.arange(len(q) + 1))
        down, near_id = (-exact[order]).tolist(), p_id[some[order]].tolist()
        for i in np.unique(who).tolist():
            a, b = begin[i], min(begin[i] + k, begin[i + 1])
            ids.append(q_id[at + i])
            found.append([{"down": s, "vec_id": v} for s, v in zip(down[a:b], near_id[a:b])])
    return pa.table([pa.array(ids, pa.int64()), pa.array(found, kind)], ["id", "found"])


def _product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products summed from the first number on, the same wherever a row stands."""
    out = np.zeros(len(p))
    for column in range(q.shape[1]):
        out = out + q[:, column] * p[:, column]
    return out
