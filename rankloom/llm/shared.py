"""The folder that the driver and all executors share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.places import shared_dir, shared_path, stored

__all__ = ["broadcast_if_small", "cut", "divided", "give_back", "shared_dir", "shared_path", "sized", "steady", "stored"]

KEYS = 2_000_000  # 64-bit keys that may be broadcast to divide a table
_STEADY = ("Project", "Filter", "Relation")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder: later uses survive a lost executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``cut``, in as many partitions as the result needs: small tables do not make many small files."""
    done = cut(df)
    return done.coalesce(max(1, -(-done.count() // rows)))


def steady(df: DataFrame) -> DataFrame:
    """``df`` itself where it only reads files, so that every reading deals the same rows to the same tasks; else stored."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = (line.lstrip(" +-:").split(" ")[0].split("[")[0] for line in plan.toString().splitlines() if line.strip())
    return df if plan.deterministic() and all(n in _STEADY for n in nodes) else stored(df)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a count of the rows; a plain join beyond it."""
    return F.broadcast(df) if df.count() <= rows else df


def divided(df: DataFrame, key: Column, keys: DataFrame, rows: int = KEYS) -> tuple[DataFrame, DataFrame]:
    """The rows whose key, a 64-bit hash, is in the one column of ``keys``, and all others.

    Up to ``rows`` keys are broadcast and no row moves; more are joined.  Two values that share a
    hash are divided alike, so the caller still joins the first part on the values themselves.
    """
    hint = broadcast_if_small(stored(keys.toDF("_key").distinct()), rows)
    same = key == F.col("_key")
    return df.join(hint, same, "left_semi"), df.join(hint, same, "left_anti")


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: Python workers go on to later stages with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass
