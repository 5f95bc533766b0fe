"""Where tables go that the driver and all executors must see."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: The most that a task is given of files, or of a shuffle's parts put together, while a table is stored.
PART_BYTES = 8 << 20
_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this machine only where that is unset and Spark is local, as in tests."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rankloom-shared-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rankloom-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _bytes(size: str) -> int:
    """A size as Spark writes it: digits and a unit, none for bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


@contextmanager
def small_parts(spark: SparkSession) -> Iterator[None]:
    """Tasks of what runs inside are given ``PART_BYTES`` at most, or less if the session says so; then its sizes are as before.

    Entries and histograms take 5 to 15 bytes a row in files and shuffles and some 500 in the sorts
    and hash tables of a task, so the usual 64 and 128 MB would be gigabytes.
    """
    large = {name: spark.conf.get(name, None) for name in _SIZES if _bytes(spark.conf.get(name)) > PART_BYTES}
    for name in large:
        spark.conf.set(name, f"{PART_BYTES}b")
    try:
        yield
    finally:
        for name, size in large.items():
            spark.conf.unset(name) if size is None else spark.conf.set(name, size)


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as Parquet in the shared folder: later uses read that, and survive a lost executor."""
    path = shared_path(df.sparkSession, "table")
    with small_parts(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this session has put there, once no result that reads it is needed any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
