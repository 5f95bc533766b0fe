"""A reference pool prepared once for many runs.

What a test needs of its reference is kept as three small tables: a row for each gene (sums, zeros
and the tie term), the histogram of values, and the histogram's sums by bucket.  The histogram is
bucketed by gene and value bucket and sorted by value inside, so targets are dealt to where it
lies, and neither the pool nor its histogram is shuffled or summed again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize, ranks
from .matrix import CountMatrix, noncount_signal
from .places import small_parts

#: The label of the pool's cells inside a run; sides keep it apart from a target of that name.
POOL = "reference"
_VALUES = "gene_idx int, bucket int, v double, rc bigint"
#: Rows of the histogram for each of its files, about.
_ROWS = 4_000_000


@dataclass(frozen=True)
class Reference:
    """An opened reference; ``total`` is the target sum that its values were scaled to (None: as they were)."""

    spark: SparkSession
    path: str
    manifest: dict

    @property
    def total(self) -> float | None:
        return self.manifest["total"]

    @property
    def n_cells(self) -> int:
        return self.manifest["n_cells"]

    @property
    def buckets(self) -> int:
        """In how many parts the histogram lies."""
        return self.manifest["buckets"]

    @cached_property
    def genes(self) -> DataFrame:
        """``(gene_idx, feature)``."""
        return self.moments.select("gene_idx", "feature")

    @cached_property
    def moments(self) -> DataFrame:
        """``(gene_idx, feature, nnz, sum_x, sum_raw, sum_log, sum_cpm, ref_tie)``, a row for each gene."""
        return self.spark.read.parquet(f"{self.path}/moments")

    @cached_property
    def coarse(self) -> DataFrame:
        """``(gene_idx, bucket, own)``: how many cells have a value in each bucket."""
        return self.spark.read.parquet(f"{self.path}/coarse")

    @cached_property
    def values(self) -> DataFrame:
        """``(gene_idx, bucket, v, rc)``, read in the parts in which it was written."""
        name = f"rankloom_reference_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({_VALUES}) USING parquet CLUSTERED BY (gene_idx, bucket) SORTED BY (gene_idx, bucket, v) INTO {self.buckets} BUCKETS LOCATION '{self.path}/values'")
        return self.spark.table(name)

    def groups(self) -> DataFrame:
        """The pool as a group of cells: one row."""
        m = self.manifest
        return self.spark.range(1).select(F.lit(1).alias("side"), F.lit(POOL).alias("group"), F.lit(m["n_cells"]).cast("long").alias("n_cells"), F.lit(m["library"]).alias("library"), F.lit(m["library1"]).alias("library1"))

    def fits(self, genes: DataFrame) -> bool:
        """Whether ``genes(gene_idx, feature)`` are the pool's, in number and order."""
        pair = genes.select("gene_idx", F.col("feature").alias("a")).join(self.genes.withColumnRenamed("feature", "b"), "gene_idx", "full")
        return pair.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def prepare(pool: CountMatrix, path: str, total: float | None = None) -> Reference:
    """Read a pool once and keep at ``path`` what any run against it needs; values are scaled to ``total`` if that is given.

    Every number is exact or summed in double once: runs against the prepared reference and against
    the pool itself agree.  A pool without cells is a ValueError.
    """
    spark = pool.cells.sparkSession
    if isinstance(total, str):
        raise NotImplementedError("a prepared reference needs its target sum as a number: the median is taken over targets too")
    rows = normalize.gathered(pool.entries, pool.cells.select("cell_id"))
    with small_parts(spark):
        rows.write.option("compression", "zstd").parquet(f"{path}/cells")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/cells")
    first = F.col("first")
    n_cells, library, library1 = rows.agg(F.count(F.when(first, 1)), F.sum(F.when(first, F.col("library"))), F.sum(F.when(first, F.when(F.col("library") == 0, 1.0).otherwise(F.col("library"))))).first()
    if not n_cells:
        raise ValueError("the reference pool has no cells")
    seen = normalize.histogram(rows.where("gene_idx is not null"), ["gene_idx"], total, True)
    moments = normalize.moments(seen, ["gene_idx"], True, True)
    moments = pool.genes.select(F.col("gene_idx").cast("int").alias("gene_idx"), "feature").join(moments, "gene_idx", "left").fillna(0, [c for c in moments.columns if c != "gene_idx"])
    zeros = moments.where(F.col("nnz") < n_cells).select("gene_idx", F.lit(0.0).alias("v"), (F.lit(n_cells) - F.col("nnz")).alias("rc"))
    values = seen.where("v <> 0").groupBy(F.col("gene_idx").cast("int").alias("gene_idx"), "v").agg(F.sum("n").alias("rc")).unionByName(zeros).withColumn("bucket", ranks.bucket(F.col("v"))).select("gene_idx", "bucket", "v", "rc")
    with small_parts(spark):
        values.write.option("compression", "zstd").parquet(f"{path}/histogram")
    values = spark.read.schema(_VALUES).parquet(f"{path}/histogram")
    buckets = max(spark.sparkContext.defaultParallelism, -(-values.count() // _ROWS))
    name = f"rankloom_values_{uuid.uuid4().hex}"
    values.repartition(buckets, "gene_idx", "bucket").write.bucketBy(buckets, "gene_idx", "bucket").sortBy("gene_idx", "bucket", "v").option("path", f"{path}/values").option("compression", "zstd").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    values.groupBy("gene_idx", "bucket").agg(F.sum("rc").alias("own")).coalesce(max(1, buckets // 8)).write.parquet(f"{path}/coarse")
    ties = values.groupBy("gene_idx").agg(F.sum(ranks.cubed(F.col("rc"), n_cells > ranks.CUBE_LIMIT)).cast("decimal(38,0)").alias("ref_tie"))
    moments.join(ties, "gene_idx", "left").coalesce(max(1, buckets // 8)).write.parquet(f"{path}/moments")
    manifest = {"total": total, "n_cells": n_cells, "library": library, "library1": library1, "buckets": buckets, "counts": not noncount_signal(rows.where("value is not null"))}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return open_reference(spark, path)


def open_reference(spark: SparkSession, path: str) -> Reference:
    """A reference that ``prepare`` wrote, in this session or another."""
    try:
        return Reference(spark, path, json.loads(spark.read.text(f"{path}/manifest").first()[0]))
    except Exception as error:
        raise ValueError(f"{path} is not a prepared reference: its manifest cannot be read") from error
