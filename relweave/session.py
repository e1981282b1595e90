"""Spark session defaults, lineage cutting and scale parameters."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Scale:
    """Sizes that decide when an ordered or grouped operator splits its work.

    ``block_rows`` is the number of rows one task may order on its own. A key (or a whole
    table) that holds more is cut into blocks. ``max_blocks`` bounds the per-block tables
    and the list of block bounds; ``broadcast_rows`` and ``broadcast_bytes`` bound a counted
    side that may be broadcast.
    """

    block_rows: int = 1_000_000
    max_blocks: int = 16_384
    max_hot_keys: int = 100_000
    oversample: int = 32
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64_000_000


DEFAULT_SCALE = Scale()


def build_session(app: str = "relweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # wide bundles: the JVM never compiles a generated method above this size
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster every executor
    has to reach the files, so a missing setting is an error there.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if not context.getCheckpointDir():
            context.setCheckpointDir(path)
        return path
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="relweave-")
    context.setCheckpointDir(path)
    return path


_SCOPES: list[list[DataFrame]] = []


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and continue from the written table.

    The table is Parquet rather than an RDD checkpoint: later steps read only the columns they
    need, and its known size lets Spark choose joins. It survives the loss of executors. It stays until
    ``discard`` or the end of the ``scratch`` it was written in. ``codec`` is one of Parquet's, where the
    session's is not wanted.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def spread(df: DataFrame) -> DataFrame:
    """The rows of a written table, dealt out where it has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def scratch() -> Iterator[None]:
    """Tables materialized inside are deleted at the end; for steps whose results are not lazy."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            discard(df)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over.

    They go when the driver collects the objects that stand for them, which a driver with much memory
    may not do for hours; a long job of many written steps asks for it. The last step is held by events
    that are still on their way, hence the pauses.
    """
    for pause in (0.5, 1.0):
        time.sleep(pause)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a ``materialize``d table that nothing will read again; other tables are left alone."""
    context = df.sparkSession.sparkContext
    if written := getattr(df, "_written", None):
        folders = {written}
    else:
        home = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/".removeprefix("file:").lstrip("/")
        folders = {folder for folder in (f.rpartition("/")[0] for f in df.inputFiles()) if home in folder}
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
