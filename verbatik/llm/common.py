"""What the operators of this package share: scratch tables, row hashing, folds and word splitting."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Distinct words that a counting task holds before it hands them on.
COUNTER_LIMIT = 300_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir.

    Where it is unset a local session uses a folder of its own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Scratch tables of the blocks of scratch_of() that are open, innermost last.
_open: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and read it back; lineage ends there, and a lost executor loses nothing.

    The table stays until discard(), or until the end of a block of scratch_of() around it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def scratch_of():
    """A block at whose end the scratch tables that were made in it are deleted; what is to outlive it is made outside."""
    _open.append([])
    try:
        yield
    finally:
        for made in _open.pop():
            discard(made)


@contextmanager
def outlasting():
    """A block whose scratch tables outlast the blocks of scratch_of() around it."""
    held = _open[:]
    _open.clear()
    try:
        yield
    finally:
        _open[:] = held


def discard(df: DataFrame) -> None:
    """Delete a scratch table that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key gives null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def fields(df: DataFrame, more: str) -> StructType:
    """df's schema and further fields, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_bytes(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column, without decoding; null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def squeeze(values: np.ndarray) -> bytes:
    """An array as bytes, compressed plane by plane."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T if len(values) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def give_back(spark: SparkSession) -> None:
    """What the driver's Python and JVM no longer use goes back to the system: a step's collected tables, plans and broadcasts
    would else count beside those of the next one."""
    gc.collect()
    _trim()
    spark._jvm.System.gc()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run):
    """run, which maps batches, and after its last batch the task's freed memory goes back to the system: a Python worker
    serves one stage after the other, and would keep the largest task's memory through all of them."""

    def mapped(batches):
        yield from run(batches)
        _trim()

    return mapped


def word_counts(docs: DataFrame, text: str, flags: list[str], lower: bool = False, limit: int = COUNTER_LIMIT) -> DataFrame:
    """Occurrences of every word of all texts: (word binary, n_<flag> long for each flag column).

    A word is a run of bytes other than space and \\t-\\r. flags are names of boolean columns; n_<flag> counts
    the occurrences in rows where it is true. Words are counted within each task before the shuffle, `limit` distinct
    ones at a time.
    """
    schema = "word binary, " + ", ".join(f"n_{f} long" for f in flags)

    def count(batches):
        counters: dict[tuple, Counter] = {}

        def flush():
            for on, counter in counters.items():
                n = pa.array(list(counter.values()), pa.int64())
                none = pa.array(np.zeros(len(counter), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), *(n if flag else none for flag in on)], names=["word", *(f"n_{f}" for f in flags)])
            counters.clear()

        for batch in batches:
            marks = list(zip(*(batch.column(f).to_pylist() for f in flags), strict=True))
            for body, on in zip(as_bytes(batch.column("body")), marks, strict=True):
                if body:
                    on = tuple(bool(x) for x in on)
                    if on not in counters:
                        counters[on] = Counter()
                    counters[on].update((body.lower() if lower else body).split())
                    if len(counters[on]) > limit:
                        yield from flush()
        yield from flush()

    rows = docs.select(F.col(text).alias("body"), *(F.col(f).alias(f) for f in flags)).mapInArrow(trimmed(count), schema)
    return rows.groupBy("word").agg(*(F.sum(f"n_{f}").alias(f"n_{f}") for f in flags))
