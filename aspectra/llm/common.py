"""Helpers shared by the operators of this folder: tables, lineage cuts, shared files."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions.sizes import row_bytes
from aspectra.session import scratch_path

BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` below the cluster's shared folder and read it back: a lineage cut that
    outlives executors. Returns the table and its path, for ``discard``."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that a later stashed table no longer needs."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of every query go when that query ends. For phases that
    write a table and are never run again, so the next phase finds the disk free."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def fits_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of a (small or written) table together take at most so many bytes; they are counted."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= most


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, rows: int):
    """Arrow batches cut to at most ``rows`` rows, so that Python holds little at a time."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def type_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


# Python workers outlive the stage they were started for, so what one operator keeps in them
# (language models, an encoder's cache) would stand beside the data of all later operators.
_STATE: dict = {}


def worker_state(key, make: Callable):
    """The object that this Python worker keeps between tasks under ``key``; it has one at a time."""
    if key not in _STATE:
        drop_worker_state()
        _STATE[key] = make()
    return _STATE[key]


def drop_worker_state() -> None:
    if _STATE:
        _STATE.clear()
        gc.collect()
        return_memory()


def return_memory() -> None:
    """Give freed memory back to the system, which C and Arrow allocators else keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, in a worker that keeps nothing before it nor after it."""

    def tidy(batches):
        drop_worker_state()
        yield from run(batches)
        return_memory()

    return tidy
