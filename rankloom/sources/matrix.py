"""Measurement matrices in long form, and the adapters that make them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import MISSING_LABELS
from .places import stored


@dataclass(frozen=True)
class CountMatrix:
    """``entries(cell_id, gene_idx, value)`` without zeros, ``cells(cell_id, labels...)``, ``genes(gene_idx, feature)``.

    ``gene_idx`` runs from 0 without gaps and is the key: two features may share a name.
    Repeated entries of one cell and gene are summed.  Values are finite; null counts as zero.
    """

    entries: DataFrame
    cells: DataFrame
    genes: DataFrame

    def gene_count(self) -> int:
        return self.genes.count()

    def same_genes(self, other: CountMatrix) -> bool:
        """The same features in the same order."""
        pair = self.genes.select("gene_idx", F.col("feature").alias("a")).join(other.genes.select("gene_idx", F.col("feature").alias("b")), "gene_idx", "full")
        return pair.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def from_table(table: DataFrame, cell: str, gene: str, value: str | Column, cells: DataFrame | None = None) -> CountMatrix:
    """A matrix from a long table; genes are numbered in the order of their names.

    The table is read once, into the shared folder; names are numbered from there.  The number of
    a gene is its rank among the distinct names.
    """
    value = F.col(value) if isinstance(value, str) else value
    own = stored(table.select(F.col(cell).alias("cell_id"), F.col(gene).alias("_g"), value.cast("double").alias("value")))
    genes = stored(numbered(own.select("_g").distinct(), "_g", "gene_idx"))
    entries = own.join(genes, "_g").select("cell_id", "gene_idx", "value")
    return CountMatrix(entries, cells if cells is not None else own.select("cell_id").distinct(), genes.select("gene_idx", F.col("_g").cast("string").alias("feature")))


def numbered(df: DataFrame, by: str, name: str, parts: int = 64, kind: str = "int") -> DataFrame:
    """Rows numbered from 0 in the order of ``by``, without a single task that sees them all."""
    from pyspark.sql import Window

    ranged = df.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).select("_part", "_start")  # a row for each part
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_own") - 1).cast(kind)).drop("_part", "_own", "_start")


def from_vectors(table: DataFrame, cell: str, vector: str, width: int, labels: Sequence[str] = ()) -> CountMatrix:
    """A matrix from rows that hold a dense array each; position is the gene."""
    entries = table.select(F.col(cell).alias("cell_id"), F.posexplode(vector).alias("gene_idx", "value")).where("value <> 0").withColumn("value", F.col("value").cast("double"))
    genes = table.sparkSession.range(width).select(F.col("id").cast("int").alias("gene_idx"), F.col("id").cast("string").alias("feature"))
    return CountMatrix(entries, table.select(F.col(cell).alias("cell_id"), *labels), genes)


def from_dense(spark: SparkSession, values: Any, labels: dict[str, Sequence] | None = None, features: Sequence[str] | None = None, first_cell: int = 0) -> CountMatrix:
    """A matrix from a small array in the driver (tests, bring-your-own groups); sparse ones with ``toarray`` too."""
    array = np.asarray(values.toarray() if hasattr(values, "toarray") else values)
    if array.ndim != 2:
        raise ValueError(f"a matrix has two dimensions, got {array.ndim}")
    rows, columns = np.nonzero(array)
    entries = spark.createDataFrame(pd.DataFrame({"cell_id": rows.astype(np.int64) + first_cell, "gene_idx": columns.astype(np.int32), "value": array[rows, columns].astype(np.float64)}), "cell_id long, gene_idx int, value double")
    labels = labels or {}
    cells = spark.createDataFrame([(i + first_cell, *(None if v[i] is None or v[i] != v[i] else str(v[i]) for v in labels.values())) for i in range(len(array))], ", ".join(["cell_id long", *(f"`{k}` string" for k in labels)]))
    features = [f"g{j}" for j in range(array.shape[1])] if features is None else features
    if len(features) != array.shape[1]:
        raise ValueError(f"{len(features)} features for {array.shape[1]} columns")
    return CountMatrix(entries, cells, spark.createDataFrame([(j, str(f)) for j, f in enumerate(features)], "gene_idx int, feature string"))


class CellGroup(NamedTuple):
    """One target's cells: a matrix (CountMatrix, array or sparse) and, at will, the rows of it that count; ``groups`` reads them."""

    label: str
    X: Any
    rows: Any = None


def checked_rows(rows: Any, height: int, label: str) -> np.ndarray:
    """A group's row selector: unique whole numbers within its height."""
    found = np.asarray(rows)
    if found.size == 0 and found.ndim == 1:
        return found.astype(np.int64)
    if found.dtype == bool or not np.issubdtype(found.dtype, np.integer):
        raise TypeError(f"rows of group {label!r} must be integers, got {found.dtype}")
    if found.ndim != 1:
        raise ValueError(f"rows of group {label!r} must have one dimension")
    if len(found) and (found.min() < 0 or found.max() >= height or len(np.unique(found)) < len(found)):
        raise ValueError(f"rows of group {label!r} must be unique and within 0..{height - 1}")
    return found


def collapse_reference(label: Column, prefix: str, reference: str) -> Column:
    """Labels that begin with ``prefix`` become the reference label."""
    return F.when(label.startswith(prefix), F.lit(reference)).otherwise(label)


def reject_missing(cells: DataFrame, column: str, spelled: bool = False) -> None:
    """No null labels; where labels are only text, none of the four spellings of one either."""
    bad = F.col(column).isNull()
    if spelled:
        bad = bad | F.col(column).isin(*MISSING_LABELS)
    if not cells.where(bad).isEmpty():
        raise ValueError(f"missing labels in {column!r}: drop or name those cells first")


def noncount_signal(entries: DataFrame) -> bool:
    """Whether any value is negative or fractional; exact, over all entries."""
    return not entries.where((F.col("value") < 0) | (F.abs(F.col("value") - F.rint("value")) > 1e-6)).isEmpty()
