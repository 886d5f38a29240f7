"""Shared helpers of the training-data operators: staging, reading, joins that survive a hot key."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many groups can each hold more than 1/HOT_SHARE of all rows, so a table of them is small by pigeonhole.
HOT_SHARE = 2000
HOT_FLOOR = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where none is set and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives a lost executor.

    The path is kept as ``df.staged_at`` so that ``drop`` can free it once nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # The schema is given so that an empty table, which may hold no part file, reads back as well.
    return owned_table(spark.read.schema(df.schema).parquet(path), path)


#: The staged tables of the innermost open scratch, if any.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def owned_table(df: DataFrame, path: str) -> DataFrame:
    """``df``, which reads the folder ``path``, as a staged table of the open scratch."""
    df.staged_at = path
    if (held := _SCRATCH.get()) is not None:
        held.append(df)
    return df


@contextmanager
def scratch() -> Iterator[None]:
    """Owns the tables staged inside and deletes them at its end; those given to ``keep`` go to the scratch around it."""
    held: list[DataFrame] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        kept = [df for df in held if getattr(df, "kept", False)]
        drop(*(df for df in held if not any(df is k for k in kept)))
        if (outer := _SCRATCH.get()) is not None:
            for df in kept:
                df.kept = False
                outer.append(df)


def keep(staged: DataFrame) -> DataFrame:
    """Spare a staged table that the result still reads."""
    staged.kept = True
    return staged


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return this process's freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable, clear: Callable[[], None] | None = None) -> Callable:
    """``run`` for mapInArrow, which gives its memory back to the system when a partition ends.

    Python workers outlive their tasks; what an idle one still held would be missing to the stages after it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if clear:
                clear()
            give_back()

    return task


def hot_cutoff(total: int) -> int:
    return max(HOT_FLOOR, total // HOT_SHARE)


def attach_group(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per group, without shuffling a hot group's rows onto one task.

    Groups of more than ``total / 2000`` rows number at most 2000, whatever the input, so they are broadcast; the
    others are joined by an ordinary shuffle in which no key can dominate. ``size`` names the group-size column.
    """
    cut = hot_cutoff(total)
    hot = F.broadcast(groups.where(F.col(size) > cut))
    cold = groups.where(F.col(size) <= cut)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key, "left"))


def as_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns, whatever they are called, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
