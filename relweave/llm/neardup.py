"""Near-duplicate documents by circulant MinHash, bands, and exact verification.

C-MinHash needs two permutations of the hash space only: sigma shuffles the shingles once, and
coordinate k of the signature is the least pi(sigma(x) + k * step), the second permutation applied
after a circular shift by k. Bands of a few coordinates propose pairs; a link counts only if the
intersection of the full shingle sets confirms it.

Groups of thousands of copies are met without pairs inside a group:

1. Documents with equal shingle sets become one (their least id stands for them).
2. Every band bucket has a leader, drawn by a hash; each document is verified against the one of its
   buckets' leaders whose signature agrees best. Confirmed links give components. This is repeated with
   other leaders for the buckets that hold several components, so that large groups grow together.
3. Buckets that still hold several components are searched for all pairs across components (never
   within one). Their documents come with their sets and a second, longer signature, by which pairs well below
   the similarity are told apart block by block; the others are verified on the spot. A block joins what it
   links, so large groups cost it no more links than they have components. That catches every link the leaders missed.

Sets are named by numbers, and only buckets that hold two of them go on from the first look, as (bucket, number);
signatures and sets are fetched for the pairs that need them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import documents, map_batches, type_of
from relweave.llm.components import components
from relweave.session import discard, materialize, release

SHINGLE = 5
SIMILAR = (75, 100)
BANDS, ROWS = 24, 3
#: Equal low bytes, of all coordinates, below which a pair cannot reach the similarity: four and a
#: half standard deviations under the expected number.
LEAST_AGREE = 37
#: Coordinates of the second signature, and how many of its bytes must be equal: again four and a half deviations
#: under the number expected at the similarity, which leaves pairs below about 0.66 out.
LONG, LEAST_LONG = 512, 340
BLOCK = 500
#: Rounds of leaders before the search across components.
TURNS = 3
_K = BANDS * ROWS
_SHIFTS = (np.arange(LONG, dtype=np.uint64) * np.uint64(0x9E3779B1) % np.uint64(1 << 32)).astype(np.uint32)
_STEPS = _SHIFTS[:_K]
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


_WORDS = _Words()


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; a shorter text is one shingle."""
    words = text.lower().split()  # ASCII letters and ASCII white space only, as these are bytes
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _MULTIPLY[i % 5] ^ np.uint64(i)
    total ^= total >> np.uint64(31)
    total *= _MULTIPLY[0]
    return np.unique(total ^ (total >> np.uint64(29)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int = _K) -> np.ndarray:
    """The coordinates of a non-empty set: two permutations, the second after a circular shift."""
    sigma = _mix((shingles >> np.uint64(32)).astype(np.uint32))
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), 256):
        least = np.minimum(least, _mix(sigma[at : at + 256, None] + _SHIFTS[None, :size]).min(0))
    return least


def _sketch(batch: pa.RecordBatch) -> dict:
    sizes, keys, bands, marks = [], [], [], []
    for t in batch["text"]:
        s = shingle_hashes(t.as_py())
        sizes.append(len(s))
        keys.append(xxhash.xxh128_digest(s.tobytes()))
        if len(s):
            sig = signature(s)
            bands.append([xxhash.xxh64_intdigest(b.tobytes(), seed=i) - (1 << 63) for i, b in enumerate(sig.reshape(BANDS, ROWS))])
            marks.append(sig.astype(np.uint8).tobytes())
        else:
            bands.append([])
            marks.append(b"")
    return {"doc_id": batch["doc_id"], "n": sizes, "key": keys, "bands": pa.array(bands, pa.list_(pa.int64())), "mark": marks}


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    A null, empty or wordless text has no shingles and no links: it stays alone. A null id takes part in
    no link and is kept. Rows that repeat an id are read as one document's texts, linked to each other.
    Other columns are not read. Bands and sieve are made for links at 0.75; a lower ``similar`` is refused.
    """
    if similar[0] * SIMILAR[1] < SIMILAR[0] * similar[1]:
        raise ValueError(f"bands are made for a similarity of {SIMILAR[0]}/{SIMILAR[1]} or more")
    docs = documents(df, doc_id, text).select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = type_of(docs, "doc_id")
    rows = materialize(map_batches(docs, _sketch, f"doc_id {kind}, n long, key binary, bands array<long>, mark binary"))
    full = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = full.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("mark").alias("mark"))
    reps = materialize(reps.withColumn("num", F.monotonically_increasing_id()))  # written with the sets, so they keep it
    names = materialize(full.select("doc_id", "key").distinct().join(reps.select("key", "rep"), "key").select("doc_id", "rep"))
    same = names.filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # a bucket's number holds its band; those with one set cannot propose anything
    spread = reps.select("num", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("num").alias("x"), F.max("num").alias("y")).filter("x < y").select("bucket")
    live = materialize(spread.join(shared, "bucket"))
    marks = reps.select("num", "n", "mark")

    def close(batch):
        a = np.frombuffer(b"".join(batch["ma"].to_pylist()), np.uint8).reshape(-1, _K)
        b = np.frombuffer(b"".join(batch["mb"].to_pylist()), np.uint8).reshape(-1, _K)
        na, nb = (batch[c].to_numpy() for c in ("na", "nb"))
        alike = (a == b).sum(1)
        fits = similar[0] * np.maximum(na, nb) <= similar[1] * np.minimum(na, nb)
        keep = pa.array((alike >= LEAST_AGREE) & fits)
        return {"a": batch["a"].filter(keep), "b": batch["b"].filter(keep), "alike": pa.array(alike, pa.int64()).filter(keep)}

    links, ends = None, None
    for turn in range(TURNS):
        joined = _placed(live, ends)
        rank = F.xxhash64("num", "bucket", F.lit(turn)).alias("rank")
        filled = joined.groupBy("bucket").agg(F.min(F.struct(rank, "num", "comp")).alias("lead"), F.min("comp").alias("x"), F.max("comp").alias("y"))
        leads = filled.filter("x < y").select("bucket", F.col("lead.num").alias("b"), F.col("lead.comp").alias("other"))
        pairs = joined.join(leads, "bucket").filter(F.col("comp") != F.col("other")).select(F.col("num").alias("a"), "b").distinct()
        for c in "ab":
            pairs = pairs.join(marks.select(F.col("num").alias(c), F.col("n").alias(f"n{c}"), F.col("mark").alias(f"m{c}")), c)
        scored = map_batches(pairs, close, "a long, b long, alike long")
        best = materialize(scored.groupBy("a").agg(F.max_by("b", F.struct("alike", "b")).alias("b")))
        found = verified(docs, reps, best, similar)
        old, last = links, ends
        links = found if links is None else materialize(links.unionByName(found))
        ends = components(links)
        for done in [best, *([] if old is None else [old, found, last])]:
            discard(done)
        release(df.sparkSession)

    # then all pairs across the components that are left in a bucket
    joined = _placed(live, ends)
    sizes = joined.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("m"), F.max_by("comp", F.struct("m", "comp")).alias("big"), F.max("m").alias("g"))
    mixed = materialize(mixed.filter("c > 1").select("bucket", "big", F.ceil((F.col("m") - F.col("g")) / BLOCK).cast("int").alias("nr"), F.ceil(F.col("g") / BLOCK).cast("int").alias("ng")))
    met = materialize(joined.join(mixed, "bucket"))
    longer = _longer(docs, reps, met.select("num").distinct())
    in_big = F.col("comp") == F.col("big")
    own = F.pmod(F.xxhash64("num"), F.when(in_big, F.col("ng")).otherwise(F.col("nr"))).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.struct(i.alias("i"), (-own - 1).alias("j")))
    mine = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("ng") - 1), lambda j: F.struct(own.alias("i"), (-j - 1).alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))),
    )
    cells = met.withColumn("cell", F.explode(F.when(in_big, others).otherwise(mine)))
    cells = cells.select("bucket", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "num", "comp").join(longer, "num")
    cells = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "comp")
    across = cells.mapInArrow(lambda batches: _across(batches, similar), "a long, b long")
    more = materialize(across.distinct())
    ids = reps.select("num", "rep")
    linked = links.unionByName(more)
    for c, x in (("a", "x"), ("b", "y")):
        linked = linked.join(ids.select(F.col("num").alias(c), F.col("rep").alias(x)), c)
    linked = linked.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b")
    final = components(linked.unionByName(same))
    for done in (live, mixed, met, longer, links, more, ends, names, reps):
        discard(done)
    out = rows.join(final, rows["doc_id"] == final["node"], "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _placed(live: DataFrame, ends: DataFrame | None) -> DataFrame:
    """(num, bucket, comp): the component of every set of a bucket, its own number where it has no link."""
    if ends is None:
        return live.select("num", "bucket", F.col("num").alias("comp"))
    roots = ends.select(F.col("node").alias("num"), "root")
    return live.join(roots, "num", "left").select("num", "bucket", F.coalesce("root", "num").alias("comp"))


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame, column: str, fn) -> DataFrame:
    """(num, column): ``fn`` of the shingle set of every wanted number, written."""
    named = materialize(reps.select("key", "rep", "num").join(wanted, "num"))
    kind = type_of(docs, "doc_id")

    def sets(batch):
        found = [shingle_hashes(t.as_py()) for t in batch["text"]]
        return {"key": [xxhash.xxh128_digest(x.tobytes()) for x in found], column: [fn(x) for x in found], "rep": batch["rep"]}

    texts = docs.join(named.select("rep").distinct(), F.col("doc_id") == F.col("rep")).select("text", "rep")
    held = map_batches(texts, sets, f"key binary, {column} binary, rep {kind}")
    # an id may stand for several texts: only the set with the wanted key counts
    held = materialize(held.join(named.select("key", "rep", "num"), ["key", "rep"]).groupBy("num").agg(F.first(column).alias(column)))
    discard(named)
    return held


def _longer(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(num, mark): the second signature, in low bytes, and then the shingles of every wanted set, written."""

    def mark(x: np.ndarray) -> bytes:
        return signature(x, LONG).astype(np.uint8).tobytes() + x.tobytes() if len(x) else b""

    return _texts(docs, reps, wanted, "mark", mark)


def _across(batches, similar):
    """Links between different components in each cell, verified on full sets.

    A cell joins the components it links and skips pairs that are joined by then, so that it hands on fewer
    links than it has components, whatever the sizes of these."""
    held, current = [], None

    def flush():
        mark = np.frombuffer(b"".join(x[1][:LONG] for x in held), np.uint8).reshape(-1, LONG)
        sets = [np.frombuffer(x[1], np.uint64, offset=LONG) for x in held]
        n = np.array([len(x) for x in sets])
        _, comp = np.unique([x[2] for x in held], return_inverse=True)
        a, b = [], []
        for i in range(len(held) - 1):
            if comp.min() == comp.max():
                break
            rest = slice(i + 1, None)
            fits = (comp[rest] != comp[i]) & (similar[0] * np.maximum(n[rest], n[i]) <= similar[1] * np.minimum(n[rest], n[i]))
            near = np.flatnonzero(fits)
            near = near[(mark[i + 1 + near, :_K] == mark[i, :_K]).sum(1) >= LEAST_AGREE]
            alike = (mark[i + 1 + near] == mark[i]).sum(1)
            for j in (near[np.argsort(-alike, kind="stable")] + i + 1)[: (alike >= LEAST_LONG).sum()].tolist():
                if comp[i] != comp[j]:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if similar[1] * shared >= similar[0] * (n[i] + n[j] - shared):
                        comp[comp == comp[j]] = comp[i]
                        a.append(held[i][0])
                        b.append(held[j][0])
        return a, b

    for batch in batches:
        a, b = [], []
        columns = [batch[c].to_pylist() for c in ("bucket", "i", "j", "num", "mark", "comp")]
        for bucket, i, j, *row in zip(*columns):
            if (bucket, i, j) != current:
                if len(held) > 1:
                    x, y = flush()
                    a += x
                    b += y
                held, current = [], (bucket, i, j)
            held.append(row)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    if len(held) > 1:
        a, b = flush()
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs of numbers whose full shingle sets are similar enough, written."""
    spots = pairs.select(F.col("a").alias("num")).unionByName(pairs.select(F.col("b").alias("num"))).distinct()
    held = _texts(docs, reps, spots, "shingles", np.ndarray.tobytes)
    left, right = (held.select(F.col("num").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")

    def confirm(batch):
        good = []
        for x, y in zip(batch["sa"], batch["sb"]):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good.append(similar[1] * shared >= similar[0] * (len(x) + len(y) - shared))
        keep = pa.array(good, pa.bool_())
        return {"a": batch["a"].filter(keep), "b": batch["b"].filter(keep)}

    out = materialize(map_batches(both.select("a", "b", "sa", "sb"), confirm, "a long, b long"))
    discard(held)
    return out
