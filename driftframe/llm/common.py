"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text per Arrow batch; bounds what a Python worker holds at once.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20
#: 64-bit words of a bitmap of hashes.
WORDS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches by rows and bytes: very long texts don't pile up in a worker. These settings of the session stay, as plans are made later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own where that is unset (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not (found := spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="driftframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone at exit; the folder's owner clears it then
        pass


def release(spark: SparkSession) -> None:
    """Frees the disk of finished queries: their shuffle files go when the driver collects its garbage, which it may not do for long."""
    gc.collect()
    spark._jvm.System.gc()


#: Tables cut within each open ``passing``.
_PASSING: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession, kept: int = 1) -> Iterator[None]:
    """Tables cut within are removed at its end, but for the last ``kept``; nothing that is still to be computed may read the others."""
    _PASSING.append(paths := [])
    try:
        yield
        for path in paths[:-kept]:
            remove(spark, path)
    finally:
        _PASSING.pop()


def cut(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` once as a Parquet table in the shared folder and returns a reader of it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    for paths in _PASSING:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: A hash's word in a bitmap are its first bits.
_SHIFT = 64 - WORDS.bit_length() + 1


def bitmap(rows: DataFrame, name: str) -> F.Column:
    """The bitmap, WORDS longs, of the hashes in column ``name``; ``in_bitmap`` looks into it.

    It is a subquery of one row, which plans only name. A literal is written out wherever a plan is described, and
    the driver describes a plan with each of its stages and keeps that.
    """
    words = rows.groupBy(F.shiftrightunsigned(name, _SHIFT).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")))
    filled = dict(map(tuple, words.collect()))  # WORDS rows at most, however many hashes
    bits = pa.array([[filled.get(w, 0) for w in range(WORDS)]], pa.list_(pa.int64()))
    return rows.sparkSession.createDataFrame(pa.table({"bits": bits})).scalar()


def in_bitmap(h: F.Column, bits: F.Column) -> F.Column:
    """Whether a hash is in the bitmap ``bits``, or another of the same bit."""
    return F.getbit(F.get(bits, F.shiftrightunsigned(h, _SHIFT).cast("int")), h.bitwiseAND(63).cast("int")) == 1
