"""Library sizes, the target they are scaled to, and staged values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import log1p_ieee
from . import ranks


def canonical(entries: DataFrame) -> DataFrame:
    """One entry for each cell and gene: repeated ones summed, nulls and zeros gone."""
    return entries.groupBy("cell_id", "gene_idx").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0")


def library_sizes(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with ``library``, the sum of each cell's values as given; cells without entries have zero."""
    sums = entries.groupBy("cell_id").agg(F.sum(F.col("value").cast("double")).alias("library"))
    return cells.join(sums, "cell_id", "left").withColumn("library", F.coalesce("library", F.lit(0.0)))


def gathered(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with a row for each of a cell's values, and one with a null gene for a cell that has none.

    ``library`` is on every row of the cell and ``first`` marks one of them.  All of it is done
    where the cell's rows are; a cell has no more rows than there are genes.
    """
    own = entries.select("cell_id", "gene_idx", F.col("value").cast("double").alias("value")).repartition("cell_id")
    own = own.groupBy("cell_id", "gene_idx").agg(F.sum("value").alias("value")).where("value <> 0")
    of_cell = Window.partitionBy("cell_id")
    library, first = F.coalesce(F.sum("value").over(of_cell), F.lit(0.0)), F.row_number().over(of_cell.orderBy("gene_idx")) == 1
    return cells.join(own, "cell_id", "left").withColumn("library", library).withColumn("first", first)


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column, from running counts of its distinct values by narrow buckets; null without values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("rc"))
    if counts.isEmpty():
        return None
    at = ranks.placed(counts.withColumn("of", F.lit(0)), ["of"])
    upto, many = F.col("less") + F.col("eq"), F.lit(counts.agg(F.sum("rc")).first()[0])
    middle = [F.min(F.when(upto * 2 >= many, F.col("v"))), F.min(F.when(upto * 2 > many, F.col("v")))]
    low, high = at.agg(*(m.alias(f"m{i}") for i, m in enumerate(middle))).first()
    return (low + high) / 2


def resolve_total(total: float | str | None, libraries: DataFrame) -> float | None:
    """The target sum as a number; ``"median"`` is that of the positive library sizes."""
    if total != "median":
        return total
    found = exact_median(libraries.where("library > 0"), "library")
    if found is None:
        raise ValueError("normalize_target_sum='median': no cell has a positive total")
    return found


def row_scale(total: float) -> Column:
    """The factor of a cell, worked out in double and kept in single precision; an empty library counts as one."""
    return (F.lit(total) / F.when(F.col("library") == 0, 1.0).otherwise(F.col("library"))).cast("float")


def staged(value: Column, total: float | None) -> Column:
    """Single precision values, scaled in single precision: this decides which values tie."""
    return value.cast("float") if total is None else value.cast("float") * row_scale(total)


def histogram(rows: DataFrame, keys: list[str], total: float | None, cpm: bool) -> DataFrame:
    """``(keys..., v, n, raw[, cpm])``: how often each staged value stands, and the sums of what it was made from."""
    raw = F.col("value").cast("float").cast("double")
    sums = [F.count("*").alias("n"), F.sum(raw).alias("raw")]
    if cpm:
        sums.append(F.sum(raw * row_scale(1e6).cast("double")).alias("cpm"))
    return rows.groupBy(*keys, staged(F.col("value"), total).cast("double").alias("v")).agg(*sums)


def moments(seen: DataFrame, keys: list[str], geometric: bool, cpm: bool) -> DataFrame:
    """A histogram's sums for each of ``keys``: values that are not zero, their sum, that of the raw ones, of logarithms and of millionths."""
    v, n = F.col("v"), F.col("n")
    sums = [F.sum(F.when(v != 0, n).otherwise(0)).alias("nnz"), F.sum(v * n).alias("sum_x"), F.sum("raw").alias("sum_raw")]
    if geometric:
        sums.append(F.sum(log1p_ieee(v) * n).alias("sum_log"))
    if cpm:
        sums.append(F.sum("cpm").alias("sum_cpm"))
    return seen.groupBy(*keys).agg(*sums)


def log1p_normalized(entries: DataFrame, cells: DataFrame, total: float) -> DataFrame:
    """Entries scaled to the total and passed through log1p."""
    sized = library_sizes(entries, cells.select("cell_id"))
    return entries.join(sized, "cell_id").select("cell_id", "gene_idx", F.log1p((F.col("value").cast("float") * row_scale(total)).cast("double")).alias("value"))
