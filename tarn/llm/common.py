"""What the operators of this package share: the folder for written tables, and exact-order helpers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.runtime import work_dir, written

__all__ = ["ascii_lower", "fresh_path", "small_batches", "texts", "work_dir", "written"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. A text of one byte a character takes the fast path, where ``lower`` does the same."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of ``docs``, and the columns named in ``more``; other columns are left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def small_batches(batches, size: int = 4 << 20):
    """Arrow batches cut so that each holds about ``size`` bytes, and one row at least. After the last one the worker gives back what it no longer needs, since it stays for the next task."""
    for batch in batches:
        n = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
    pa.default_memory_pool().release_unused()
    _trim()


def _trim() -> None:
    """Freed memory back to the system, where the C library has a call for it."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
