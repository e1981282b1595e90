"""Hard negatives by exact whole-number scores from a residue-number-system matrix product.

Vectors of whole numbers are kept as their residues modulo several small primes, one byte each. Scores of
anchors against rows are matrix products of residues in float32, one per prime: with residues centred on
zero no sum reaches 2**24, so every product is exact. Mixed-radix Chinese remaindering turns the remainders
of a score into the score itself, sign included; the primes are as many as the longest vector asks for.

Anchors meet all rows in tiles, (part of the anchors) x (block of the rows), of bounded size:

1. rows of the anchor's own label: its positives, the best few;
2. rows of other labels: for each positive the best of those whose score lies in that positive's window.

Either step first searches one block in ``SEED``, which gives every list a threshold, and then all blocks,
which hand on only what reaches it. So what is handed on per anchor does not grow with the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.session import materialize

#: Rows in a block and anchors in a part; fewest rows a block is cut into for the sake of idle cores.
BLOCK, PART, SMALL = 65_536, 32_768, 2_048
#: One block in so many gives the first thresholds.
SEED = 64
#: Anchors and rows multiplied at once.
_TALL, _WIDE = 128, 16_384
_EXACT = 1 << 24
_LEAST = np.iinfo(np.int64).min
PRIMES = [n for n in range(255, 2, -1) if all(n % m for m in range(2, math.isqrt(n) + 1))]


def primes_for(bound: int) -> list[int]:
    """Enough primes below 256 to tell all scores from ``-bound`` to ``bound`` apart."""
    if bound >= 1 << 62:
        raise ValueError("scores of these vectors do not fit in 62 bits")
    product, out = 1, []
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 2 * bound + 1:
            break
    return out


def residues(x: np.ndarray, primes: list[int]) -> np.ndarray:
    """(prime, row, column): whole numbers as their remainders nearest to zero."""
    return np.stack([_centred(np.fmod(x, p), p).astype(np.int8) for p in primes])


def products(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact scores of all rows of ``a`` with all rows of ``b``, both given by their residues."""
    digits, columns = [], a.shape[2]
    for k, p in enumerate(primes):
        wide = max(1, (_EXACT - 1) // (p // 2) ** 2)  # columns whose products can be summed exactly
        rest = np.zeros((a.shape[1], b.shape[1]))
        for at in range(0, columns, wide):
            part = a[k, :, at : at + wide].astype(np.float32) @ b[k, :, at : at + wide].astype(np.float32).T
            rest = _centred(rest + part, p)
        for j, q in enumerate(primes[:k]):
            rest = _centred((rest - digits[j]) * pow(q, -1, p), p)
        digits.append(rest)
    out, weight = np.zeros(rest.shape, np.int64), 1
    for digit, p in zip(digits, primes):
        out += digit.astype(np.int64) * np.uint64(weight % (1 << 64)).astype(np.int64)  # wraps, the sum does not
        weight *= p
    return out


def _centred(whole: np.ndarray, p: int) -> np.ndarray:
    """Remainders nearest to zero of whole numbers below 2**40: no quotient lies near a half, as p is odd."""
    return whole - p * np.rint(whole * (1 / p))


# ------------------------------------------------------------------------------- mining


def mine(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows ``anchors`` holds for.

    An anchor's positives are its best other rows of its label; for each, the first rows of other labels
    with ``window[0]`` to ``window[1]`` hundredths of the positive's score are its negatives. Higher scores
    come first, ties by smaller id. Vectors hold whole numbers; ids and labels are whole numbers.

    A row with a null id, label or vector, an empty vector, or a null or non-finite number takes no part;
    vectors meet those of their own dimension. Rows of an equal id are not "other" rows of each other; an id
    that repeats is one anchor (its least label and vector) and as many candidates as rows. A positive
    without negatives, or an anchor without positives, has no rows. Scores of 62 bits or more are an error.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter((F.size("x") > 0) & finite)
    longest = F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    n, n_asked, top = rows.agg(F.count(F.lit(1)), F.count_if("asks"), longest).first()
    top = top or 0.0
    primes = primes_for(int(top * (1 + 1e-9)) + 1 if math.isfinite(top) else 1 << 62)
    base = materialize(_packed(rows, primes))
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / BLOCK), min(2 * cores, n // SMALL))
    parts = max(1, math.ceil(n_asked / PART))
    deal = F.col("deal")
    once = Window.partitionBy("id").orderBy("label", "dim", "r")
    asked = base.filter("asks").withColumn("k", F.row_number().over(once)).filter("k = 1")
    asked = materialize(asked.select("id", "dim", "label", "r", (deal % parts).cast("int").alias("part")))
    base_rows = base.select("id", "dim", "label", "r", (deal % blocks).cast("int").alias("block"))

    def search(asked: DataFrame, fn, most: int, schema: str, by: list[str]) -> DataFrame:
        """Lists of the ``most`` best rows: thresholds from the seed blocks first, then every block."""
        best = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")

        def over(rows: DataFrame, some: list[int], asked: DataFrame) -> DataFrame:
            found = _tiles(asked, rows, some, parts, fn, schema)
            return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)

        seeds = list(range(0, blocks, SEED))
        aimed = asked.withColumn("least", F.lit(None).cast("array<long>"))
        if blocks > SEED:
            first = over(base_rows.filter(F.col("block") % SEED == 0), seeds, aimed).filter(F.col("rank") == most)
            marks = first.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("list", "score"))).alias("marks"))  # one per list of the anchor
            lists = F.transform(F.sequence(F.lit(0), F.lit(max(1, positives))), lambda k: F.coalesce(F.try_element_at("marks", k.cast("int")), F.lit(_LEAST)))
            aimed = asked.join(marks, "id", "left").withColumn("least", F.when(F.col("marks").isNotNull(), lists)).drop("marks")
        return over(base_rows, list(range(blocks)), aimed)

    def own_label(left: pa.Table, right: pa.Table) -> pa.Table:
        return _positives(left, right, primes, positives)

    def other_labels(left: pa.Table, right: pa.Table) -> pa.Table:
        return _negatives(left, right, primes, negatives, window)

    schema = "id long, list int, vec_id long, score long"
    near = materialize(search(asked, own_label, positives, schema, ["id"]))
    of_anchor = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))  # the few positives
    aimed = asked.join(of_anchor.select("id", F.col("s.score").alias("scores")), "id")
    hard = search(aimed, other_labels, negatives, schema, ["id", "list"])
    pairs = near.select("id", F.col("rank").alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["id", "list"])
    return hard.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _packed(rows: DataFrame, primes: list[int]) -> DataFrame:
    """Usable rows with their residues; ``deal`` numbers them, so that equal ids are spread too."""

    def pack(batches):
        at = TaskContext.get().partitionId() * 7_919
        for batch in batches:
            made = [residues(np.array(v, float)[None, :], primes).tobytes() for v in batch["x"].to_pylist()]
            dim = pa.array(np.diff(batch["x"].offsets.to_numpy()), pa.int32())
            deal = pa.array((at + np.arange(batch.num_rows)) % (1 << 40), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["asks"], dim, deal, pa.array(made, pa.binary())], ["id", "label", "asks", "dim", "deal", "r"])

    return rows.mapInArrow(pack, "id long, label long, asks boolean, dim int, deal long, r binary")


def _tiles(asked: DataFrame, rows: DataFrame, blocks: list[int], parts: int, fn, schema: str) -> DataFrame:
    """``fn`` on every part of the anchors with every block of the rows."""
    keys = ["dim", "part", "block"]
    step = blocks[1] - blocks[0] if len(blocks) > 1 else 1
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(blocks[0]), F.lit(blocks[-1]), F.lit(step))))
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else rows.withColumn("part", F.lit(0))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def _residues(table: pa.Table, primes: list[int]) -> np.ndarray:
    raw = np.frombuffer(b"".join(table["r"].to_pylist()), np.int8)
    return raw.reshape(table.num_rows, len(primes), -1).transpose(1, 0, 2)


def _found(parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
    names = ["id", "list", "vec_id", "score"]
    return pa.table([pa.array(c.astype(np.int32 if n == "list" else np.int64)) for n, c in zip(names, columns)], names)


def _first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the best scores, ties by smaller id."""
    if len(score) > 4 * most:
        some = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:most]]


def _positives(left: pa.Table, right: pa.Table, primes: list[int], most: int) -> pa.Table:
    """The best other rows of each anchor's label within a tile."""
    if not left.num_rows or not right.num_rows:
        return _found([])
    a, b, a_id, b_id = _residues(left, primes), _residues(right, primes), left["id"].to_numpy(), right["id"].to_numpy()
    a_label, b_label = left["label"].to_numpy(), right["label"].to_numpy()
    least = [v[1] if v else _LEAST for v in left["least"].to_pylist()]
    out = []
    for label in np.unique(a_label).tolist():
        mine, theirs = np.flatnonzero(a_label == label), np.flatnonzero(b_label == label)
        for i in range(0, len(mine), _TALL):
            who = mine[i : i + _TALL]
            for j in range(0, len(theirs), _WIDE):
                some = theirs[j : j + _WIDE]
                for row, score in zip(who.tolist(), products(a[:, who], b[:, some], primes)):
                    live = np.flatnonzero((score >= least[row]) & (b_id[some] != a_id[row]))
                    live = live[_first(score[live], b_id[some[live]], most)]
                    out.append((np.full(len(live), a_id[row]), np.ones(len(live)), b_id[some[live]], score[live]))
    return _found(out)


def bounds(score: int, window: tuple[int, int]) -> tuple[int, int]:
    """The whole scores from ``window[0]`` to ``window[1]`` hundredths of a score."""
    return -(-window[0] * score // 100), window[1] * score // 100


def _negatives(left: pa.Table, right: pa.Table, primes: list[int], most: int, window: tuple[int, int]) -> pa.Table:
    """For each positive of each anchor, the best rows of other labels in its window within a tile."""
    if not left.num_rows or not right.num_rows:
        return _found([])
    a, b, a_id, b_id = _residues(left, primes), _residues(right, primes), left["id"].to_numpy(), right["id"].to_numpy()
    a_label, b_label = left["label"].to_numpy(), right["label"].to_numpy()
    wanted, least = left["scores"].to_pylist(), left["least"].to_pylist()
    out = []
    for i in range(0, len(a_id), _TALL):
        for j in range(0, len(b_id), _WIDE):
            whole = products(a[:, i : i + _TALL], b[:, j : j + _WIDE], primes)
            ids, labels = b_id[j : j + _WIDE], b_label[j : j + _WIDE]
            for row, score in enumerate(whole, i):
                spans = [bounds(s, window) for s in wanted[row]]
                spans = [(max(low, least[row][k]) if least[row] else low, high) for k, (low, high) in enumerate(spans, 1)]
                live = np.flatnonzero((score >= min(s[0] for s in spans)) & (score <= max(s[1] for s in spans)) & (labels != a_label[row]))
                live = live[np.lexsort((ids[live], -score[live]))]
                down = -score[live]
                for k, (low, high) in enumerate(spans, 1):
                    start, end = np.searchsorted(down, -high), np.searchsorted(down, -low, "right")
                    some = live[start : min(end, start + most)]
                    out.append((np.full(len(some), a_id[row]), np.full(len(some), k), ids[some], score[some]))
    return _found(out)


#: The same rows by every anchor's product with every row.
MINE_SQL = """with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, p.vec_id, p.label = a.label as same, cast(list_dot_product(a.e, p.e) as bigint) as score
  from v a join v p on p.vec_id <> a.vec_id where a.vec_id % 100 = 0),
near as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
hard as (
  select n.anchor_id, n.positive_id, s.vec_id as negative_id, n.positive_score, s.score as negative_score,
    row_number() over (partition by n.anchor_id, n.positive_id order by s.score desc, s.vec_id) as rank
  from near n join s on s.anchor_id = n.anchor_id and not s.same
    and 30 * n.positive_score <= 100 * s.score and 100 * s.score <= 90 * n.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from hard where rank <= 10"""
