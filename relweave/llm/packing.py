"""Packing token streams into sequences of fixed length, with controlled source mixture.

Deficit round-robin over one queue per source. A window is a number of sequences; for each window
every queue earns its share of the window's ids, serves the whole ids it has earned, and carries the
fraction (its deficit) into the next window. What queue s has served after x ids of windows is
therefore floor(weight(s) * x), a closed form: every task knows, from the totals per source alone,
where each id of its documents goes, and deficits carry across windows and partitions alike without
any task seeing the whole stream. The default weights are the sources' own shares, so that all queues
run dry together and every window holds the mixture of the whole table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.common import documents, running_offsets, type_of
from relweave.llm.tokens import as_ids, file_coder
from relweave.session import materialize

SEQUENCE = 2_048
#: Sequences in a window.
WINDOW = 64


class Mixture:
    """What every queue has served after each window.

    ``totals`` are the ids per source; ``weights`` the wanted proportions (the totals if None). A queue
    that runs dry stops; a window whose wanted queues have run dry is filled by the others.
    """

    def __init__(self, totals: dict, window_ids: int, weights: dict | None = None):
        self.sources = list(totals)
        left = [totals[s] for s in self.sources]
        wanted = [max(0.0, float((weights or totals).get(s, 0))) for s in self.sources]
        # phases: until the next queue runs dry, the served ids grow in fixed proportion (exact integers)
        scale = 1_000_000
        share = [int(w) if weights is None else round(w * scale) for w in wanted]
        self.phases, at, served = [], 0, [0] * len(left)
        while any(left):
            live = [i for i, n in enumerate(left) if n]
            total = sum(share[i] for i in live)
            rate = [share[i] if i in live and total else int(not total and i in live) for i in range(len(left))]
            total = sum(rate)
            # the first queue to run dry ends the phase
            span = min(-(-left[i] * total // rate[i]) for i in live if rate[i])
            self.phases.append((at, at + span, rate, total, list(served)))
            for i in live:
                gone = min(left[i], rate[i] * span // total)
                left[i] -= gone
                served[i] += gone
            at += span
        self.length, self.window_ids = at, window_ids
        self.windows = -(-at // window_ids) if at else 0
        self.ends = [p[1] for p in self.phases]

    def served(self, window: int) -> list[int]:
        """Ids every queue has served before this window."""
        x = min(window * self.window_ids, self.length)
        if not self.phases or x <= 0:
            return [0] * len(self.sources)
        start, _, rate, total, before = self.phases[min(bisect_right(self.ends, x - 1), len(self.phases) - 1)]
        return [b + r * (x - start) // total for b, r in zip(before, rate)]


def tokenised(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, source, part, at, ids, n): the ids of every row, dealt by ranges of (source, doc_id).

    ``at`` counts the ids before the row within its part and source; ``ids`` keeps the coder's width.
    The result is written, so that later steps read the same order.
    """
    docs = documents(df, doc_id, text).withColumn("source", F.lit(None).cast("string"))
    if source in df.columns:
        docs = df.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
            F.col(source).cast("string").alias("source"),
        )
    docs = docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id", "text")
    docs = docs.withColumn("part", F.spark_partition_id())
    width = 2 if file_coder(tokenizer, pattern).code == "H" else 4
    tail = np.array([end_id], f"<u{width}").tobytes()

    def code(batches):
        coder, current, at = file_coder(tokenizer, pattern), ("no source yet",), 0
        for batch in batches:
            found, starts, sizes = [], [], []
            for t, s in zip(batch["text"], batch["source"]):
                if (s.as_py(),) != current:
                    current, at = (s.as_py(),), 0
                raw = coder.encode_one(t.as_py()) + tail
                found.append(raw)
                starts.append(at)
                sizes.append(len(raw) // width)
                at += sizes[-1]
            own = {c: batch[c] for c in ("doc_id", "source", "part")}
            yield pa.RecordBatch.from_pydict(own | {"at": starts, "ids": found, "n": sizes})

    schema = f"doc_id {type_of(docs, 'doc_id')}, source string, part int, at long, ids binary, n long"
    return materialize(docs.mapInArrow(code, schema))


def pack(
    spark: SparkSession,
    rows: DataFrame,
    width: int,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    weights: dict | None = None,
) -> DataFrame:
    """Pieces of sequences from ``tokenised`` rows.

    (doc_id, source, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset): ``ids`` are
    unsigned 32-bit integers; every id lies in one piece; a sequence is gapless, and all but the last
    are full, so that the padding is below one sequence for the whole table. The totals per part and
    source that go to the driver are at most parts + sources rows, as a part is a range of sources.
    """
    found = rows.groupBy("source", "part").agg(F.sum("n").alias("n")).collect()
    totals: dict = {}
    for r in sorted(found, key=lambda r: (r["source"] is not None, r["source"] or "", r["part"])):
        totals[r["source"]] = totals.get(r["source"], 0) + r["n"]
    before = {
        s: running_offsets([(r["part"], r["n"]) for r in found if r["source"] == s], 0, 1) for s in totals
    }
    mixture = Mixture(totals, sequence * window, weights)
    place = {s: i for i, s in enumerate(mixture.sources)}
    code = "H" if width == 2 else "I"
    names = ["doc_id", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches):
        known: dict[int, tuple[list[int], list[int], int]] = {}

        def served(w: int) -> tuple[list[int], int, list[int]]:
            if w not in known:
                if len(known) > 4_096:
                    known.clear()
                a, b = mixture.served(w), mixture.served(w + 1)
                place_in, at = [], sum(a)
                for x, y in zip(a, b):
                    place_in.append(at - x)  # add a position in the queue to get one in the stream
                    at += y - x
                known[w] = (b, place_in, a)
            return known[w]

        for batch in batches:
            out = {c: [] for c in names}
            for d, s, part, at, raw, n in zip(*(batch[c].to_pylist() for c in ("doc_id", "source", "part", "at", "ids", "n"))):
                q, ids = place[s], as_ids(raw, code).astype("<u4")
                first = at + before[s][part]
                p, end = first, first + n
                w = _window_of(mixture, q, p)
                while p < end:
                    ends, shift, _ = served(w)
                    stop = min(end, ends[q])
                    while p < stop:
                        g = p + shift[q]
                        size = min(stop - p, sequence - g % sequence)
                        piece = ids[p - first : p - first + size].tobytes()
                        row = (d, s, p - first, size, piece, zlib.crc32(piece), n, g // sequence, g % sequence)
                        for c, v in zip(names, row):
                            out[c].append(v)
                        p += size
                    w += 1
            arrays = [pa.array(out["doc_id"], batch["doc_id"].type), pa.array(out["source"], pa.string())]
            arrays += [pa.array(out[c], pa.binary() if c == "ids" else pa.int64()) for c in names[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {type_of(rows, 'doc_id')}, source string, start long, length long, ids binary, "
    schema += "ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(cut, schema)


def _window_of(mixture: Mixture, q: int, position: int) -> int:
    """The window in which a queue serves a position: the first that has served more."""
    low, high = 0, max(mixture.windows - 1, 0)
    while low < high:
        mid = (low + high) // 2
        if mixture.served(mid + 1)[q] > position:
            high = mid
        else:
            low = mid + 1
    return low
