"""Token ids of documents in a compressed, checksummed file format, and its reader.

The format is a folder of Parquet files. A row is a segment: whole documents in ascending id order,
their lengths, and their ids in blocks that the context-mixing range coder compresses independently
(see ``mixcoder``). Each block has a crc32 over its ids; a damaged block raises ValueError. A segment
is read on its own, so files split anywhere between segments and a lost task is simply read again.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.common import documents, running_offsets, type_of
from relweave.llm.mixcoder import decode, encode
from relweave.llm.tokens import as_ids, file_coder

#: Ids after which a segment ends; a longer document is a segment of its own.
SEGMENT_IDS = 2_000_000
BITS = 24

_SCHEMA = (
    "doc_ids array<{kind}>, part int, number int, first long, n_ids long, bits int, lengths binary, "
    "payload binary, words binary, sums binary"
)


def write(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of every text and ``end_id`` after each, by ascending document id.

    A null or empty text is its end id alone; null document ids come first; rows that share an id are
    ordered by text. Ids must lie below 2**24. The rows are dealt by ranges of the document id, and
    each task writes its range in order, so ``part`` and ``number`` order the segments.
    """
    docs = documents(df, doc_id, text)
    parts = docs.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    parts = parts.withColumn("part", F.spark_partition_id())
    kind = type_of(docs, "doc_id")
    schema = _SCHEMA.format(kind=kind)
    tail = {c: np.array([end_id], f"<u{2 if c == 'H' else 4}").tobytes() for c in "HI"}

    def segments(batches):
        coder, held, size, number, first = file_coder(tokenizer, pattern), [], 0, 0, 0
        part = 0

        def flush():
            raw = b"".join(x[1] for x in held)
            ids = as_ids(raw, coder.code)
            bits = max(4, int(ids.max()).bit_length())
            if bits > BITS:
                raise ValueError("ids must lie below 2**24")
            payload, words, sums = encode(ids, bits)
            width = 2 if coder.code == "H" else 4
            lengths = np.array([len(x[1]) // width for x in held], "<u8").tobytes()
            row = [[x[0] for x in held]], [part], [number], [first], [len(ids)], [bits], [lengths], [payload], [words], [sums]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], names
            )

        names = [f.split(" ")[0] for f in schema.split(", ")]
        types = [None, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        for batch in batches:
            types[0] = pa.list_(batch["doc_id"].type)
            for d, t, p in zip(batch["doc_id"], batch["text"], batch["part"]):
                raw, part = coder.encode_one(t.as_py()) + tail[coder.code], p.as_py()
                held.append((d.as_py(), raw))
                size += len(raw) // (2 if coder.code == "H" else 4)
                if size >= segment_ids:
                    yield flush()
                    first, number, held, size = first + size, number + 1, [], 0
        if held:
            yield flush()

    parts.mapInArrow(segments, schema).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents of a written folder; ``ids`` as little-endian unsigned
    32-bit integers with the end id, ``start`` the number of ids of all documents before."""
    stored = spark.read.parquet(path)
    sums = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a written partition
    before = {int(k): v for k, v in running_offsets([(r["part"], r["n"]) for r in sums], 0, 1).items()}
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def back(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names if c != "doc_ids"}
                ids = decode(row["payload"], row["words"], row["sums"], row["n_ids"], row["bits"])
                ends = np.cumsum(np.frombuffer(row["lengths"], "<u8").astype(np.int64))
                raw, at, start = ids.tobytes(), row["first"] + row["before"], 0
                docs, starts, found = batch["doc_ids"][i].values, [], []
                for end in ends.tolist():
                    starts.append(at + start)
                    found.append(raw[4 * start : 4 * end])
                    start = end
                yield pa.RecordBatch.from_pydict({"doc_id": docs, "start": starts, "ids": found})

    joined = stored.join(F.broadcast(offsets), "part")
    return joined.mapInArrow(back, f"doc_id {kind}, start long, ids binary")
