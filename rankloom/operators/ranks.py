"""Rank statistics from value histograms.

Ranks are taken over ``(gene, value) -> counts``, not over cells.  A gene's values are cut into
narrow buckets; a running total over the buckets of a gene and one inside each bucket give the
counts below and at every value, so the largest task holds a bucket, not a gene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest count whose cube fits a BIGINT.
CUBE_LIMIT = 2_097_151
#: Buckets for one doubling of the value.
_FINE = 64


def cubed(count: Column, wide: bool) -> Column:
    """t**3 - t, exact: in BIGINT while counts allow it, else in DECIMAL."""
    c = count.cast("decimal(38,0)" if wide else "long")
    return (c * c * c).cast("decimal(38,0)") - c if wide else c * c * c - c


def bucket(value: Column) -> Column:
    """A number that never falls as the value rises; infinities share the outermost."""
    size = F.least(F.greatest(F.abs(value), F.lit(1e-320)), F.lit(1.7e308))
    size = F.floor(F.log2(size) * _FINE).cast("int") + 80_000
    return F.when(value == 0, 0).when(value > 0, size).otherwise(-size)


def with_zeros(seen: DataFrame, skeleton: DataFrame) -> DataFrame:
    """``(side, group, gene_idx, v, n)``: values seen with their counts, and a row for the cells without one.

    ``skeleton(side, group, gene_idx, n_cells, nnz)`` has every group and gene; values that
    vanished in single precision are zeros.
    """
    zeros = skeleton.where("n_cells > nnz").select("side", "group", "gene_idx", F.lit(0.0).alias("v"), (F.col("n_cells") - F.col("nnz")).alias("n"))
    return seen.where("v <> 0").select("side", "group", "gene_idx", "v", "n").unionByName(zeros)


def placed(rows: DataFrame, keys: list[str], keep_bucket: bool = False, coarse: DataFrame | None = None) -> DataFrame:
    """``rows(keys..., v, rc)`` with ``less`` and ``eq``: the sums of ``rc`` below and at ``v``.

    With ``coarse(keys..., bucket, own)``, the sums by bucket, ``rows`` have their bucket already
    and are not read for them.
    """
    if coarse is None:
        rows = rows.withColumn("bucket", bucket(F.col("v")))
        coarse = rows.groupBy(*keys, "bucket").agg(F.sum("rc").alias("own"))
    before = coarse.select(*keys, "bucket", (F.sum("own").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("own")).alias("before"))
    inside = Window.partitionBy(*keys, "bucket")
    upto = F.sum("rc").over(inside.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.sum("rc").over(Window.partitionBy(*keys, "bucket", "v"))
    fine = rows.withColumn("eq", at).withColumn("upto", upto)
    return fine.join(before, [*keys, "bucket"]).withColumn("less", F.col("before") + F.col("upto") - F.col("eq")).drop("before", "upto", *([] if keep_bucket else ["bucket"]))


def against_reference(hist: DataFrame, factors: list[float], wide: bool, reference=None, genes: DataFrame | None = None) -> DataFrame:
    """``(group, gene_idx, u2_k..., cross_k..., ref_tie)`` for each factor k on the target values.

    ``u2`` is twice U, a whole number; the pooled tie term is ``ref_tie + cross_k``.  The pool is
    side 1 of ``hist``, or a prepared reference, whose histogram stays in the parts it lies in; of
    that only ``genes(gene_idx)`` are read, if given.
    """
    k = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(s).alias("s")) for i, s in enumerate(factors)))).alias("k")
    target = hist.where("side = 0").select("gene_idx", "group", "v", "n", k).select("gene_idx", F.col("k.k").alias("k"), (F.col("v") * F.col("k.s")).alias("v"), "group", "n", F.lit(0).cast("long").alias("rc"))
    # The pool stands in each gene's row of values once, and targets at all factors beside it: they count nothing themselves.
    none = [F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("group"), F.lit(0).cast("long").alias("n")]
    if reference is None:
        ref = hist.where("side = 1").groupBy("gene_idx", "v").agg(F.sum("n").alias("rc"))
        where = placed(target.unionByName(ref.select("gene_idx", "v", "rc", *none)), ["gene_idx"])
        ties = ref.groupBy("gene_idx").agg(F.sum(cubed(F.col("rc"), wide)).alias("ref_tie"))
    else:
        values, own = ((df if genes is None else df.join(genes, "gene_idx", "left_semi")) for df in (reference.values, reference.coarse))
        target = target.withColumn("bucket", bucket(F.col("v"))).repartition(reference.buckets, "gene_idx", "bucket")
        coarse = own.unionByName(target.select("gene_idx", "bucket").distinct().withColumn("own", F.lit(0).cast("long"))).groupBy("gene_idx", "bucket").agg(F.sum("own").alias("own"))
        where = placed(target.unionByName(values.select("gene_idx", "bucket", "v", "rc", *none)), ["gene_idx"], coarse=coarse)
        ties = reference.moments.select("gene_idx", F.col("ref_tie").cast("decimal(38,0)" if wide else "long").alias("ref_tie"))
    where = where.where("n > 0")
    number = "decimal(38,0)" if wide else "long"
    u2 = F.col("n").cast(number) * (2 * F.col("less").cast(number) + F.col("eq").cast(number))
    cross = cubed(F.col("eq") + F.col("n"), wide) - cubed(F.col("eq"), wide)
    sums = where.groupBy("group", "gene_idx").agg(*(F.sum(F.when(F.col("k") == i, u2)).alias(f"u2_{i}") for i in range(len(factors))), *(F.sum(F.when(F.col("k") == i, cross)).alias(f"cross_{i}") for i in range(len(factors))))
    return sums.join(ties, "gene_idx", "left")


def against_rest(hist: DataFrame, wide: bool) -> DataFrame:
    """``(group, gene_idx, u2_0, tie)`` of every group against all other cells, by ranks over all cells.

    ``u2_0`` holds twice the rank sum; the caller takes m(m+1) off.
    """
    number = "decimal(38,0)" if wide else "long"
    where = placed(hist.withColumn("rc", F.col("n")), ["gene_idx"])
    twice = F.col("n").cast(number) * (2 * F.col("less").cast(number) + F.col("eq").cast(number) + 1)
    sums = where.groupBy("group", "gene_idx").agg(F.sum(twice).alias("u2_0"))
    ties = hist.groupBy("gene_idx", "v").agg(F.sum("n").alias("rc")).groupBy("gene_idx").agg(F.sum(cubed(F.col("rc"), wide)).alias("tie"))
    return sums.join(ties, "gene_idx")
