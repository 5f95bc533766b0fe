"""Two results held against each other: coverage of keys, and correlations of every shared value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks

KEYS = ("target", "feature")


def coverage(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``(n_common, only_a, only_b)``: keys in both results and in one alone, by anti joins each way."""
    a, b = (x.select(*keys).distinct() for x in (a, b))
    parts = {"n_common": a.join(b, list(keys), "left_semi"), "only_a": a.join(b, list(keys), "left_anti"), "only_b": b.join(a, list(keys), "left_anti")}
    counts = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("of"), "n") for name, df in parts.items()))
    return counts.agg(*(F.max(F.when(F.col("of") == name, F.col("n"))).alias(name) for name in parts))


def correlations(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``(column, n, pearson, spearman, largest)`` for every double column that both results have.

    Taken over common keys whose two values are finite; ``largest`` is the largest difference,
    which a correlation cannot show.  Keys must not repeat.  Spearman's ranks are averages over
    ties, from running counts of distinct values by narrow buckets.
    """
    doubles = [{c for c, t in x.dtypes if t == "double"} - set(keys) for x in (a, b)]
    shared = [c for c in a.columns if c in doubles[0] & doubles[1]]
    right = b.select(*keys, *(F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(shared)))
    left = a.select(*keys, *(F.col(f"`{c}`").alias(f"_a{i}") for i, c in enumerate(shared)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_a{i}").alias("a"), F.col(f"_b{i}").alias("b")) for i, c in enumerate(shared)))).alias("x")
    pairs = left.join(right, list(keys)).select(each).select("x.*")
    finite = [(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) for c in ("a", "b")]
    # Equal pairs of values are one row with their number.
    pairs = pairs.where(finite[0] & finite[1]).groupBy("column", "a", "b").agg(F.count("*").alias("n"))
    ranked = pairs
    for c in ("a", "b"):
        own = pairs.groupBy("column", F.col(c).alias("v")).agg(F.sum("n").alias("rc"))
        middle = (2 * F.col("less") + F.col("eq") + 1) / F.lit(2.0)
        ranked = ranked.join(ranks.placed(own, ["column"]).select("column", F.col("v").alias(c), middle.alias(f"r{c}")), ["column", c])

    def corr(x: str, y: str):
        n = F.sum("n")
        mx, my = F.sum(F.col(x) * F.col("n")) / n, F.sum(F.col(y) * F.col("n")) / n
        xx, yy, xy = (F.sum(F.col("n") * F.col(p) * F.col(q)) / n for p, q in ((x, x), (y, y), (x, y)))
        spread = F.sqrt(F.greatest(xx - mx * mx, F.lit(0.0))) * F.sqrt(F.greatest(yy - my * my, F.lit(0.0)))
        return F.when(spread > 0, (xy - mx * my) / F.when(spread > 0, spread))

    # Values are centred first, so that the sums keep their digits.
    mean = ranked.groupBy("column").agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("_ma"), (F.sum(F.col("b") * F.col("n")) / F.sum("n")).alias("_mb"), (F.sum(F.col("ra") * F.col("n")) / F.sum("n")).alias("_mr"))
    ranked = ranked.join(mean, "column").withColumns({"difference": F.abs(F.col("a") - F.col("b")), "a": F.col("a") - F.col("_ma"), "b": F.col("b") - F.col("_mb"), "ra": F.col("ra") - F.col("_mr"), "rb": F.col("rb") - F.col("_mr")})
    return ranked.groupBy("column").agg(F.sum("n").alias("n"), corr("a", "b").alias("pearson"), corr("ra", "rb").alias("spearman"), F.max("difference").alias("largest"))
