"""Byte-level BPE encoding and decoding of whole texts.

Overlapping chunk encoding: a text is cut into chunks that overlap; every chunk is pre-tokenised on
its own, in any task. Pre-tokenisation that starts at a true boundary gives the same boundaries from
there on, so two neighbours agree after the first boundary that both find in their overlap: the text
is cut there and the pieces are encoded in parallel. Neighbours that find no common boundary (one
pre-token covers the overlap) become one piece. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import documents, map_batches, type_of, values
from relweave.llm.tokens import rank_coder, rank_table

CHUNK_CHARS = 16_384
OVERLAP = 256
#: A match that ends this close to the end of a chunk may be longer in the text.
_LOOKAHEAD = 4


def encode(
    df: DataFrame,
    ranks: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, ids): the ids of each row's text as little-endian unsigned 32-bit integers.

    A null or empty text gives empty ids. Rows stay apart, equal ones too; a null id is kept. Other
    columns are not read. ``ranks`` is a file of ranks that every executor can open.
    """
    if not 0 < 2 * overlap <= chunk_chars:
        raise ValueError("the overlap must be positive and at most half a chunk")
    docs = documents(df, doc_id, text)
    kind = type_of(docs, "doc_id")

    def whole(batch):
        return {"doc_id": batch["doc_id"], "ids": rank_coder(ranks, pattern).encode(values(batch["text"]))}

    short = map_batches(docs.filter(F.length("text") <= chunk_chars), whole, f"doc_id {kind}, ids binary")
    pieces = stitched(docs.filter(F.length("text") > chunk_chars), pattern, chunk_chars, overlap)

    def part(batch):
        out = {c: batch[c] for c in ("doc_id", "digest", "copies", "first")}
        return out | {"ids": rank_coder(ranks, pattern).encode(values(batch["piece"]))}

    coded = map_batches(pieces, part, f"doc_id {kind}, digest binary, copies long, first long, ids binary")
    long = coded.groupBy("doc_id", "digest", "copies").agg(
        F.sort_array(F.collect_list(F.struct("first", "ids"))).alias("parts")
    )
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    rows = long.select("doc_id", joined.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return short.unionByName(rows.drop("copy"))


def stitched(docs: DataFrame, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, digest, copies, first, piece): texts cut at pre-token boundaries, from overlapping chunks.

    ``first`` is the number of a piece's first chunk and orders the pieces of a text.
    """
    kind = type_of(docs, "doc_id")
    texts = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))

    def chunks(batch):
        rows = [[] for _ in range(6)]
        for d, digest, copies, t in zip(*(values(batch[c]) for c in ("doc_id", "digest", "copies", "text"))):
            for k, start in enumerate(range(0, max(len(t) - overlap, 1), chunk_chars - overlap)):
                for column, v in zip(rows, (d, digest, copies, k, start, t[start : start + chunk_chars])):
                    column.append(v)
        return dict(zip(("doc_id", "digest", "copies", "k", "start", "body"), rows))

    schema = f"doc_id {kind}, digest binary, copies long, k long, start long, body string"
    cut = map_batches(texts, chunks, schema).repartition(F.col("digest"), F.col("k"))

    def bounds(batch):
        import regex

        find, left, right = regex.compile(pattern).finditer, [], []
        for start, body in zip(values(batch["start"]), values(batch["body"])):
            at = np.fromiter((m.start() for m in find(body)), np.int64)
            known = at[at <= len(body) - _LOOKAHEAD]
            left.append((start + known[known < overlap]).tolist())
            right.append((start + known[known >= chunk_chars - overlap]).tolist())
        return {c: batch[c] for c in batch.schema.names} | {"left": left, "right": right}

    marked = map_batches(cut, bounds, schema + ", left array<long>, right array<long>")
    order = Window.partitionBy("doc_id", "digest").orderBy("k")
    common = F.array_min(F.array_intersect("left", F.lag("right").over(order)))
    marked = marked.select("doc_id", "digest", "copies", "k", "start", "body", common.alias("cut"))
    end = F.coalesce(F.lead("cut").over(order), F.lead("start").over(order), F.col("start") + F.length("body"))
    marked = marked.select(
        *["doc_id", "digest", "copies", "k", "start", "body"],
        F.coalesce("cut", "start").alias("from"),
        end.alias("to"),
        F.max(F.when(F.col("cut").isNotNull() | (F.col("k") == 0), F.col("k"))).over(order).alias("first"),
    )
    own = F.col("body").substr((F.col("from") - F.col("start") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("k", "own")))
    return (
        marked.withColumn("own", own)
        .groupBy("doc_id", "digest", "copies", "first")
        .agg(F.array_join(F.transform(parts, lambda p: p["own"]), "").alias("piece"))
    )


def decode(df: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the concatenated bytes of the ids as a binary column; null ids decode to no bytes."""
    out = df.withColumn(into, F.lit(b""))

    def back(batch):
        table = rank_table(ranks).__getitem__
        found = [b"".join(map(table, np.frombuffer(x or b"", "<u4").tolist())) for x in values(batch[ids])]
        return {c: batch[c] for c in batch.schema.names} | {into: found}

    return map_batches(df, back, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields))
