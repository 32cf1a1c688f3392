"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.scratch import Scratch, fresh_path

__all__ = ["WORD", "Scratch", "crc_mod", "doc_columns", "fresh_path", "give_back", "small_batches", "table", "utf8"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that no extra column can clash with an operator's own names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % n


def give_back() -> None:
    """Called at the end of a task: workers serve many tasks, so memory that this one no longer needs goes back at once."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 2 << 20) -> Iterator[None]:
    """Tables that are written within it go to Python and back in batches of some megabytes, whatever the length of their rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most_bytes)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(text: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
