"""Scratch tables and Arrow helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor shares.

    Where that setting is absent (single-machine tests) a temporary folder is made and set.
    Folders carry the application id, so a cluster's clean-up can drop them when it ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="groveline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/groveline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what is written meanwhile go as soon as it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame, *, partition_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and read it again: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, path or scratch(df.sparkSession)
    with tidy(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table whose readers' results are already written elsewhere."""
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in order of names; none if there is no such folder."""
    fs, where = _hadoop(spark, path)
    return sorted(str(s.getPath()) for s in fs.listStatus(where)) if fs.exists(where) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the table there was written to its end."""
    fs, where = _hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of stages whose results are already written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(df: DataFrame, key: str) -> bool:
    """Whether two rows share a value of ``key``."""
    return not df.groupBy(key).count().filter("count > 1").isEmpty()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values one after another, and the offsets of each; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each (one row at least) and no more than ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // most + np.arange(batch.num_rows) // rows * (int(sizes.sum()) // most + 1)
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
