"""Helpers shared by the llm operators."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from tempfile import gettempdir

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a class for Java's and DuckDB's regular expressions.
SPACE = r"\x20\x09-\x0D"
Worker = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body uses it (the planner would repeat it)."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> SparkSession:
    """Sees to a checkpoint folder: the one that the session names, or where none is set a local one, which only a local master may have."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or str(Path(gettempdir()) / "granary-checkpoints"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that are written to be read again."""
    return shared(spark).sparkContext.getCheckpointDir()


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that no column has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of what is written and no longer named go now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Worker, *forget: Callable[[], object]) -> Worker:
    """A worker's function that leaves nothing behind at the end of a partition: workers live on, several to an executor, and what each
    keeps in caches and in freed but unreturned memory adds up."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def small_batches(spark: SparkSession, rows: int = 256, size: str = "16m") -> None:
    """Keeps Arrow batches small, by rows and by bytes: what is in one batch sits in a Python worker together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
