"""Cutting lineage in the folder that driver and executors share, and giving memory back."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set, a local session gets a folder of its own, as in tests; on a cluster
    other machines would not see it, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quillon-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed now and read from the checkpoint folder from here on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim  # of glibc; other systems do without
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    """Hands freed memory of this Python worker to the system, as workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)
