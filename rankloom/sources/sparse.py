"""Compressed sparse rows: where each row starts, and a gene and a value for every position.

Positions are cut into blocks of fixed width.  A row of the matrix is sent to the blocks that it
covers, where an as-of join (the last start at or before a position) gives every position its row.
The largest task holds a block, however long a row is, and no array comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import CountMatrix, numbered
from .places import stored

#: Positions that one task puts in order together.
BLOCK = 65_536


def unpacked(chunks: DataFrame) -> DataFrame:
    """``(position, gene_idx, value)`` from ``chunks(first, indices, data)``: runs of both arrays from position ``first`` on."""
    if not chunks.where(~F.size("indices").eqNullSafe(F.size("data")) | F.col("first").isNull()).isEmpty():
        raise ValueError("chunks need a first position, and as many indices as data")
    both = chunks.select("first", F.posexplode(F.arrays_zip("indices", "data")).alias("at", "item"))
    return both.select((F.col("first") + F.col("at")).alias("position"), F.col("item.indices").alias("gene_idx"), F.col("item.data").alias("value"))


def from_csr(starts: DataFrame, nonzeros: DataFrame, genes: DataFrame, cells: DataFrame | None = None, block: int = BLOCK) -> CountMatrix:
    """A matrix from ``starts(row, start)``, ``nonzeros(position, gene_idx, value)`` and ``genes(gene_idx, feature)``.

    Rows run from 0; ``starts`` has one more of them than the matrix, and the last start is the
    number of positions.  ``cells(row, labels...)`` names the rows; ``row`` becomes ``cell_id``.
    Rows without positions are cells without entries.  Explicit and null values are as in any
    matrix: zeros count as such and a repeated gene of a row is summed.  ValueError where rows or
    positions have gaps or repeat, starts fall, genes do not exist, or labels do not fit the rows.
    Further columns of ``starts`` and ``nonzeros`` are ignored.
    """
    starts = stored(starts.select(F.col("row").cast("long").alias("row"), F.col("start").cast("long").alias("start")))
    known, distinct, top, least, last = starts.agg(F.count("*"), F.count_distinct("row"), F.max("row"), F.min("row"), F.max("start")).first()
    if not known or distinct < known or least != 0 or top != known - 1:
        raise ValueError("rows of starts must run from 0 without gaps or repeats, and end with the number of positions")
    after = starts.select((F.col("row") - 1).alias("row"), F.col("start").alias("end"))
    spans = stored(starts.join(after, "row"))
    if not spans.where("start is null or end is null or end < start").isEmpty() or starts.where("row = 0").first()["start"] != 0:
        raise ValueError("starts must begin at 0 and never fall")
    if cells is not None:
        cells = cells.withColumn("cell_id", F.col("row").cast("long")).drop("row")
        if cells.count() != known - 1 or not spans.join(cells.select(F.col("cell_id").alias("row")), "row", "left_anti").isEmpty():
            raise ValueError(f"cells must name each of the {known - 1} rows once")
    many = genes.count()
    pieces = spans.where("end > start").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))))
    pieces = pieces.select("block", F.greatest("start", F.col("block") * block).alias("position"), F.lit(0).alias("kind"), "row", F.lit(None).cast("int").alias("gene_idx"), F.lit(None).cast("double").alias("value"))
    items = nonzeros.select(F.col("position").cast("long").alias("position"), F.col("gene_idx").cast("int").alias("gene_idx"), F.col("value").cast("double").alias("value"))
    items = items.select(F.expr(f"position div {block}").alias("block"), "position", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("row"), "gene_idx", "value")
    order = Window.partitionBy("block").orderBy("position", "kind")
    met = pieces.unionByName(items).withColumn("row", F.last("row", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag(F.struct("position", "kind")).over(order)
    met = met.withColumn("again", F.coalesce((before["kind"] == 1) & (before["position"] == F.col("position")), F.lit(False))).where("kind = 1")
    met = stored(met.select("position", "again", F.col("row").alias("cell_id"), "gene_idx", "value"))
    found, low, high, again, strange = met.agg(F.count("position"), F.min("position"), F.max("position"), F.count(F.when(F.col("again") | F.col("position").isNull(), 1)), F.count(F.when(~F.col("gene_idx").between(0, many - 1) | F.col("gene_idx").isNull(), 1))).first()
    if again or found != last or (found and (low != 0 or high != last - 1)):
        raise ValueError(f"positions must run from 0 to {last - 1} without gaps or repeats, as the last start says")
    if strange:
        raise ValueError(f"{strange} positions name genes outside 0..{many - 1}")
    return CountMatrix(met.select("cell_id", "gene_idx", "value"), cells if cells is not None else spans.select(F.col("row").alias("cell_id")), genes)


def to_csr(matrix: CountMatrix, path: str, block: int = BLOCK) -> None:
    """Write a matrix as ``starts``, ``nonzeros``, ``cells(row, cell_id, labels...)`` and ``genes`` below ``path``.

    Rows are numbered in the order of ``cell_id`` (which must not repeat), genes of a row rise.
    """
    spark = matrix.cells.sparkSession
    rows = stored(numbered(matrix.cells.select("cell_id"), "cell_id", "row", kind="long"))
    matrix.cells.join(rows, "cell_id").write.parquet(f"{path}/cells")
    matrix.genes.write.parquet(f"{path}/genes")
    own = matrix.entries.groupBy("cell_id", "gene_idx").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0")
    own = stored(own.join(rows, "cell_id").select("row", "gene_idx", "value"))
    sizes = rows.select("row").join(own.groupBy("row").agg(F.count("*").alias("n")), "row", "left").fillna(0, ["n"]).withColumn("part", F.expr(f"row div {block}"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each block of rows
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("row")) - F.col("n")
    starts = stored(sizes.withColumn("inside", inside).join(parts, "part").select("row", (F.col("before") + F.col("inside")).alias("start")))
    end = spark.range(1).select(F.lit(rows.count()).cast("long").alias("row"), F.lit(own.count()).cast("long").alias("start"))
    starts.unionByName(end).write.parquet(f"{path}/starts")
    place = F.row_number().over(Window.partitionBy("row").orderBy("gene_idx")) - 1  # a row has no more than there are genes
    own.join(starts, "row").select((F.col("start") + place).alias("position"), "gene_idx", "value").write.parquet(f"{path}/nonzeros")


def read_csr(spark, path: str) -> CountMatrix:
    """What ``to_csr`` wrote; cells have their row numbers as ids and keep their labels."""
    starts, nonzeros, cells, genes = (spark.read.parquet(f"{path}/{name}") for name in ("starts", "nonzeros", "cells", "genes"))
    return from_csr(starts, nonzeros, genes, cells.drop("cell_id"))
