"""From U and ties to variance, p-values, effect sizes, and adjusted p-values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import TINY, with_erfc
from . import ranks


def spread(tie: Column, m: Column, n: Column) -> Column:
    """Standard deviation of U with ties, kept off zero."""
    m, n = m.cast("double"), n.cast("double")
    total = m + n
    inner = (total + 1) - tie.cast("double") / F.greatest(total * (total - 1), F.lit(1.0))
    return F.sqrt(F.greatest(m * n / 12 * inner, F.lit(TINY)))


def with_p(df: DataFrame, name: str, u: Column, tie: Column, m: Column, n: Column, side: str = "both", valid: Column | None = None) -> DataFrame:
    """Add a p-value with continuity correction: two-sided (clamped to [0, 1]), or for U large ("up") or small ("down")."""
    mn = m.cast("double") * n.cast("double")
    most = {"both": F.greatest(u, mn - u), "up": u, "down": mn - u}[side]
    df = with_erfc(df, (most - mn / 2 - 0.5) / spread(tie, m, n) / F.lit(2.0 ** 0.5), "_p")
    p = F.col("_p") if side == "both" else F.col("_p") * 0.5
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) if side == "both" else p
    valid = F.lit(True) if valid is None else valid
    return df.withColumn(name, F.when(valid, p).otherwise(F.lit(float("nan")))).drop("_p")


def effect(u: Column, m: Column, n: Column) -> Column:
    """Rank-biserial effect, 2U/mn - 1; NaN without pairs."""
    mn = m.cast("double") * n.cast("double")
    return F.when(mn > 0, 2 * u / F.when(mn > 0, mn).otherwise(1.0) - 1).otherwise(F.lit(float("nan")))


def passes(target: Column, reference: Column, threshold: float) -> Column:
    """Above the threshold on either side; NaN never is, and a negative threshold lets all pass."""
    if threshold < 0:
        return F.lit(True)
    return (~F.isnan(target) & (target > threshold)) | (~F.isnan(reference) & (reference > threshold))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def adjusted(df: DataFrame, names: dict[str, str], family: str = "target", key: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg within each family, ``names`` from p-value columns to new ones.

    NaN and null stay as they are and out of the count, infinities take part and are clipped.  All
    columns go together: distinct p-values of a family and column are ranked by narrow buckets,
    running over the buckets and inside each, so the largest task holds a bucket and no family, and
    one column costs as many shuffles as many do.  Equal p-values have the largest rank.  Values of
    1 and more become 1 where they stand, as they are many.  ``key`` names a row and is needed for
    several columns, which are brought back to their rows by it.  ``df`` is read twice, or thrice
    with several columns: hand in what is cheap to read.
    """
    def real(q: Column) -> Column:
        return q.isNotNull() & ~F.isnan(q)

    columns = [F.col(f"`{p}`") for p in names]
    if len(columns) > 1 and not key:
        raise ValueError("several columns of p-values need the key of a row")
    melted = df.select(F.col(family).alias("_f"), *(F.col(c).alias(f"_key{i}") for i, c in enumerate(key or ())), F.posexplode(F.array(*columns)).alias("_c", "v")).where(real(F.col("v")))
    at = ranks.placed(melted.groupBy("_f", "_c", "v").agg(F.count("*").alias("rc")), ["_f", "_c"], keep_bucket=True)
    whole = at.groupBy("_f", "_c").agg(F.sum("rc").alias("_m"))
    at = at.join(whole, ["_f", "_c"]).withColumn("_q", F.col("_m") * F.col("v") / (F.col("less") + F.col("eq")))
    falling = Window.partitionBy("_f", "_c").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    later = at.groupBy("_f", "_c", "bucket").agg(F.min("_q").alias("_least")).withColumn("_later", F.min("_least").over(falling)).drop("_least")
    inside = F.min("_q").over(Window.partitionBy("_f", "_c", "bucket").orderBy(F.desc("v")))
    least = F.least("_own", F.coalesce("_later", F.lit(1.0)), F.lit(1.0))
    found = at.withColumn("_own", inside).join(later, ["_f", "_c", "bucket"]).where("v < 1").select("_f", "_c", "v", F.greatest(least, F.lit(0.0)).alias("_adjusted"))

    def shown(q: Column, got: Column) -> Column:
        return F.when(~real(q), q).when(q >= 1, 1.0).otherwise(got)

    if len(columns) == 1:
        (name,) = names.values()
        same = (F.col(family) == F.col("_f")) & (columns[0] == F.col("v"))
        return df.join(found.drop("_c"), same, "left").withColumn(name, shown(columns[0], F.col("_adjusted"))).drop("_f", "v", "_adjusted")
    own = [f"_key{i}" for i in range(len(key))]
    wide = melted.where("v < 1").join(found, ["_f", "_c", "v"]).groupBy(*own).agg(*(F.max(F.when(F.col("_c") == i, F.col("_adjusted"))).alias(f"_adjusted{i}") for i in range(len(columns))))
    out = df.join(wide, [F.col(c) == F.col(k) for c, k in zip(key, own)], "left")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(shown(q, F.col(f"_adjusted{i}")).alias(name) for i, (q, name) in enumerate(zip(columns, names.values()))))
