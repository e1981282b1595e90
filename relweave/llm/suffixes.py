"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

A string of ``LENGTH`` bytes that occurs twice holds the same *anchor* both times: the 32-byte string
of least hash inside it. Only anchored suffixes (one in about 85) enter the index: a sparse suffix
array, sorted by the suffix's first eight bytes and the hash of its first 32. A suffix stands for the
run of string starts whose anchor it is; its class is the hash of all bytes of that run.

``SuffixIndex`` keeps levels of doubling size. A batch gets its own array; a merge-scan of it with each
level finds suffixes that share the leading bytes: equal classes repeat as a whole, different classes
are contested. Then equal-sized levels are merged. Copies are counted per class before anything is
shuffled, so thousands of copies cost a row.

Contested runs are cut into blocks of starts that lie equally far before the anchor. The bytes common to
all strings of a block are its core: where no other run has the core, no string of the block repeats; where
all bytes of the block repeat, all of its strings do. Only blocks in between are cut finer, down to one start.

Strings are compared by 64-bit hashes of all their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import map_batches
from relweave.session import discard, materialize, release

LENGTH = 200
ANCHOR = 32
#: Batches that a table is added in; each is a hash share of the rows.
BATCHES = 2
#: Starts in a block of a contested run, coarse to fine; each a multiple of the next.
BLOCKS = (32, 8, 1)
_U = np.uint64
_POSITION = _U((1 << 36) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, base, np.uint64)]))
    return _powers[0][:n], _powers[1][:n]


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class _Bytes:
    """Hashes of any substrings of a text, from running sums."""

    def __init__(self, raw: bytes):
        self.raw, self.n = np.frombuffer(raw, np.uint8), len(raw)
        up, self.down = _power(self.n + 1)
        self.sums = np.concatenate([[_U(0)], np.cumsum(_LETTERS[self.raw] * up[:-1])])

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return _finish((self.sums[start + size] - self.sums[start]) * self.down[start] + _U(1) * np.asarray(size).astype(np.uint64))


def anchors(text: _Bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(position, first start, last start, leading hash, class) of a text's anchored suffixes."""
    if text.n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(text.n - anchor + 1)
    key = (text.hash(at, anchor) & ~_POSITION) | at.astype(np.uint64)  # ties go to the left
    w, starts = length - anchor + 1, text.n - length + 1
    grid = np.full(-(-len(key) // w) * w, 0xFFFFFFFFFFFFFFFF, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    chosen = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    position = chosen[first]
    whole = text.hash(first, last - first + length) ^ _finish((position - first).astype(np.uint64))
    return position, first, last, text.hash(position, anchor), whole


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def suffix_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(name, head, lead, class, lo, hi, at): the anchored suffixes of texts (name long, text binary)."""

    def run(batch):
        out = [[] for _ in range(7)]
        for name, t in zip(batch["name"].to_pylist(), batch["text"]):
            text = _Bytes(t.as_py())
            position, first, last, lead, whole = anchors(text, length)
            if len(position):
                eight = text.raw[position[:, None] + np.arange(8)]  # an anchor has more bytes than these
                head = np.ascontiguousarray(eight).view(">i8").ravel().astype(np.int64)
                for column, v in zip(out, (np.full(len(first), name), head, _long(lead), _long(whole), first, last, position)):
                    column.append(v)
        if out[0]:
            return dict(zip(("name", "head", "lead", "class", "lo", "hi", "at"), map(np.concatenate, out)))
        return None

    return map_batches(docs, run, "name long, head long, lead long, class long, lo long, hi long, at long")


class SuffixIndex:
    """Levels of suffix arrays (head, lead, class, n), and what their merge-scans have found."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # (rank, array), the largest first
        self.repeated: list[DataFrame] = []  # (head, lead, class) that occur more than once
        self.contested: list[DataFrame] = []  # (head, lead) of several classes

    def add(self, rows: DataFrame) -> None:
        """Index a batch of suffix rows: array, merge-scans, geometric merges."""
        batch = array = self._array(rows.select("head", "lead", "class", F.lit(1).cast("long").alias("n")))
        self._note(array)
        rank = 0
        while self.levels and self.levels[-1][0] == rank:  # scanned and merged in one pass
            old = self.levels.pop()[1]
            array = self._array(old.unionByName(array))
            self._note(array)
            rank += 1
            discard(old)
        for _, level in self.levels:
            scan = self._array(level.unionByName(batch))
            self._note(scan)
            discard(scan)
        self.levels.append((rank, array))

    @staticmethod
    def _array(rows: DataFrame) -> DataFrame:
        """Equal suffix classes counted, in suffix order within each written part."""
        made = rows.groupBy("head", "lead", "class").agg(F.sum("n").alias("n"))
        return materialize(made.sortWithinPartitions("head", "lead", "class"))

    def _note(self, array: DataFrame) -> None:
        several = array.groupBy("head", "lead").agg((F.min("class") != F.max("class")).alias("several"))
        self.repeated.append(materialize(array.filter("n > 1").select("head", "lead", "class")))
        self.contested.append(materialize(several.filter("several").select("head", "lead")))
        release(array.sparkSession)

    def repeats(self) -> tuple[DataFrame, DataFrame]:
        out = []
        for found in (self.repeated, self.contested):
            all_found = found[0]
            for more in found[1:]:
                all_found = all_found.unionByName(more)
            out.append(materialize(all_found.distinct()))
        return out[0], out[1]


def named(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with a name for each (id, text); rows that are equal in both share it and each other's spans."""
    return df.withColumn("__name", F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))))


def repeated_spans(rows: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """(__name, __spans array<struct<lo, hi>>): byte ranges covered by strings that occur more than once.

    ``rows`` has ``__name`` and ``text`` (binary). Texts under ``length`` bytes have no spans. Spans may
    overlap. A row that repeats another entirely repeats all its strings.
    """
    docs = rows.select(F.col("__name").alias("name"), "text")
    suffixes = materialize(suffix_rows(docs, length))
    index = SuffixIndex()
    for b in range(batches):
        index.add(suffixes.filter(F.pmod("name", F.lit(batches)) == b))
    repeated, contested = index.repeats()
    whole = suffixes.join(repeated, ["head", "lead", "class"]).select("name", "lo", (F.col("hi") + length).alias("hi"))

    # a class has one head and lead; grouping by it alone leaves the join free to split a hot lead
    rivals = suffixes.join(contested, ["head", "lead"]).groupBy("class")
    rivals = rivals.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", "lo", "hi", "at")).alias("r"))
    runs = rivals.groupBy("r.name").agg(F.collect_list(F.struct("r.lo", "r.hi", "r.at", "n")).alias("runs"))
    texts = docs.join(runs, "name").dropDuplicates(["name"])

    def windows(batch):
        rows = []
        for name, t, found in zip(batch["name"].to_pylist(), batch["text"], batch["runs"]):
            raw = t.as_py()
            for r in found.as_py():
                rows.append((name, r["lo"], r["at"] - r["hi"], r["at"] - r["lo"], r["n"], raw[r["lo"] : r["hi"] + length]))
        return dict(zip(("name", "run", "near", "far", "n", "bytes"), map(list, zip(*rows)))) if rows else None

    cut = materialize(map_batches(texts, windows, "name long, run long, near long, far long, n long, bytes binary"))
    for _, level in index.levels:
        discard(level)
    release(rows.sparkSession)
    found = whole
    for spans in _settle(cut, length):
        found = found.unionByName(spans)
    return materialize(found.groupBy("name").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))).withColumnsRenamed({"name": "__name", "spans": "__spans"})


def _settle(runs: DataFrame, length: int) -> list[DataFrame]:
    """Spans (name, lo, hi) of the repeated strings of contested runs (name, run, near, far, n, bytes).

    A run holds the strings that begin ``near`` to ``far`` bytes before its anchor; n is the number of its copies.
    """
    spans, wanted, before = [], None, 0
    for size in BLOCKS:
        if wanted is None:
            asked = runs.withColumn("blocks", F.lit(None).cast("array<struct<block:long,n:long>>"))
        else:
            asked = runs.join(wanted, ["name", "run"])
        cells = materialize(map_batches(asked, _cells(size, before, length), "core long, whole long, n long, name long, run long, block long, lo long, hi long"))
        groups = cells.groupBy("core", "whole").agg(F.sum("n").alias("n"), F.min(F.struct("name", "run", "block")).alias("r"))
        groups = materialize(groups)
        again = groups.filter("n > 1").select("core", "whole")
        spans.append(materialize(cells.filter("n = 1").join(again, ["core", "whole"]).select("name", "lo", "hi")))
        if size > 1:
            # cores of several contents; equal contents go on as one
            open_cores = groups.groupBy("core").agg(F.count(F.lit(1)).alias("g")).filter("g > 1").select("core")
            left = groups.join(open_cores, "core").groupBy("r.name", "r.run")
            wanted = materialize(left.agg(F.collect_list(F.struct("r.block", F.least("n", F.lit(2)).alias("n"))).alias("blocks")))
        before = size
        discard(cells)
        discard(groups)
        release(runs.sparkSession)
    return spans


def _cells(size: int, before: int, length: int):
    """Hashes of core and whole of every block of ``size`` starts; ``before`` is the size of the blocks asked for."""

    def run(batch):
        out = [[] for _ in range(8)]
        columns = (batch[c].to_pylist() for c in ("name", "run", "near", "far", "n", "blocks"))
        for (name, lo, near, far, n, blocks), t in zip(zip(*columns), batch["bytes"]):
            text = _Bytes(t.as_py())
            if blocks is None:
                block = np.arange(near // size, far // size + 1)
                many = np.full(len(block), min(n, 2))
            else:
                ratio = before // size
                block = (np.array([x["block"] for x in blocks])[:, None] * ratio + np.arange(ratio)).ravel()
                many = np.repeat([x["n"] for x in blocks], ratio)
                inside = (block * size <= far) & (block * size + size > near)
                block, many = block[inside], many[inside]
            first = block * size
            last = np.minimum(first + size - 1, length - ANCHOR)
            core = text.hash(far - first, length - (last - first)) ^ _finish(block.astype(np.uint64))
            own_first, own_last = np.maximum(first, near), np.minimum(last, far)
            start, end = far - own_last, far - own_first + length
            whole = text.hash(start, end - start) ^ _finish(((own_first << 20) + own_last).astype(np.uint64))
            k = len(block)
            found = (_long(core), _long(whole), many, np.full(k, name), np.full(k, lo), block, lo + start, lo + end)
            for column, v in zip(out, found):
                column.append(v)
        return dict(zip(("core", "whole", "n", "name", "run", "block", "lo", "hi"), map(np.concatenate, out)))

    return run


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """All columns and rows of ``df`` with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed, judged on
    the input; a null text is empty. Columns of these four names in ``df`` are replaced.
    """
    added = ["kept", "n_bytes", "n_removed", "n_spans"]
    df = df.drop(*[c for c in added if c in df.columns])
    rows = named(df, doc_id, text)
    bytes_of = F.coalesce(F.col(text), F.lit("")).cast("binary")
    spans = repeated_spans(rows.select("__name", bytes_of.alias("text")), length, batches)
    joined = rows.join(spans, "__name", "left").withColumn("__bytes", bytes_of).drop("__name")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def cut(batch):
        kept, size, gone, runs = [], [], [], []
        for t, found in zip(batch["__bytes"], batch["__spans"]):
            raw, at, parts, n = t.as_py(), 0, [], 0
            end = -1
            for s in sorted((s["lo"], s["hi"]) for s in found.as_py() or ()):
                if s[0] > end:
                    parts.append(raw[max(end, 0) : s[0]])
                    n += 1
                end = max(end, s[1])
            parts.append(raw[max(end, 0) :])
            kept.append(b"".join(parts))
            size.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            runs.append(n)
        columns = {c: batch[c] for c in batch.schema.names if c not in ("__bytes", "__spans")}
        return columns | dict(zip(added, (kept, size, gone, runs)))

    return map_batches(joined, cut, f"{own}, kept binary, n_bytes long, n_removed long, n_spans long")
