"""Shared storage and small helpers for the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, so a
lost executor never takes the only copy of a stage's output with it.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a regular expression class.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most so many bytes are broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 16_000_000

#: Rows of an Arrow batch, on either side of a worker's pipe; a batch of whole texts takes some megabytes then.
BATCH_ROWS = 1000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set and all runs in one process (tests) a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        path = tempfile.mkdtemp(prefix="packetlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/packetlens/{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its executor hold at once. The session's setting is lowered, never raised."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside remove their shuffle files when they end. For results that are collected or written once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few(rows: DataFrame) -> DataFrame:
    """``rows``, whose columns are numbers, to be broadcast if a count shows that they are few."""
    return F.broadcast(rows) if rows.count() * 16 * len(rows.columns) <= BROADCAST_BYTES else rows


def small(rows: DataFrame) -> DataFrame:
    """``rows``, which may hold texts, to be broadcast if their bytes, summed first, are few."""
    own = [F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(0) for c, t in rows.dtypes]
    size = rows.agg(F.sum(sum(own, F.lit(16 * len(own))).cast("long"))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def give_back() -> None:
    """Returns a worker's freed memory to the system; the worker lives on and waits for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` whose tasks give their memory back when they end."""

    def lean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def made() -> int:
    """How many shared paths there are, for ``drop_since``."""
    return len(_written)


def drop_since(mark: int, until: int) -> None:
    """Removes the shared paths made after ``mark`` and before ``until``: what read them has been written."""
    for spark, path in _written[mark:until]:
        remove(spark, path)
    del _written[mark:until]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with suppress(Exception):  # a session that has ended: the folder's owner cleans up
            remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, null counting as empty. No word becomes an object: every run of ink shrinks to one letter, and white space goes."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, f"{WORD}+", "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spare(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
