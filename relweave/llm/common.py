"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words here.
SPACE = r"[\x20\x09-\x0D]+"


def type_of(df: DataFrame, name: str) -> str:
    """The type of a column as a schema string."""
    return df.schema[name].dataType.simpleString()


def documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; a null text is empty."""
    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch; it returns the columns of any number of rows, or None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes of a column; a longer value is a slice with what precedes it."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(start, end - start)


def values(column: pa.Array) -> Iterator[str]:
    """The values of a column one by one, so that a batch is never held twice."""
    return (v.as_py() for v in column)


def bucket_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``: the fold of a document; a null id has no fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def running_offsets(totals: list[tuple], key: int, value: int) -> dict:
    """Exclusive prefix sums of one value per part, in the order of the parts."""
    out, at = {}, 0
    for row in sorted(totals, key=lambda r: r[key]):
        out[row[key]] = at
        at += row[value]
    return out
