"""Functions that Spark lacks, as column expressions.

``erfc`` is Cody's rational approximation (Math. Comp. 1969) in SQL text that Spark and other
SQL engines read alike; literals are in e-notation, so no engine takes them for decimals.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published coefficients, in the order of the paper's recurrences.
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
_INV_SQRT_PI = 5.6418958354775628695e-1
TINY = 2.2250738585072014e-308


def _e(x: float) -> str:
    return f"{x:.17e}"


def _ratio(top: tuple[float, ...], bottom: tuple[float, ...], y: str) -> str:
    """Both polynomials by Horner's rule: the last of ``top`` leads, ``bottom`` leads with one."""
    up, down = f"{_e(top[-1])}*{y}", y
    for a, b in zip(top[:-2], bottom[:-1]):
        up, down = f"({up}+{_e(a)})*{y}", f"({down}+{_e(b)})*{y}"
    return f"(({up}+{_e(top[-2])})/({down}+{_e(bottom[-1])}))"


def erfc_sql(x: str) -> str:
    """SQL text of erfc for a DOUBLE expression; name a column, as it is repeated."""
    y = f"abs({x})"
    q = f"(floor({y}*1.6e1)/1.6e1)"
    fall = f"exp(-{q}*{q})*exp(-({y}-{q})*({y}+{q}))"
    z = f"(1e0/({y}*{y}))"
    middle = f"{fall}*{_ratio(_C, _D, y)}"
    far = f"{fall}*(({_e(_INV_SQRT_PI)}-{z}*{_ratio(_P, _Q, z)})/{y})"
    upper = f"CASE WHEN {y} >= 2.66e1 THEN 0e0 WHEN {y} > 4e0 THEN {far} ELSE {middle} END"
    near = f"1e0-{x}*{_ratio(_A, _B, f'({x}*{x})')}"
    return f"CASE WHEN {y} <= 4.6875e-1 THEN {near} WHEN {x} < 0e0 THEN 2e0-({upper}) ELSE {upper} END"


def with_erfc(df: DataFrame, argument: Column, name: str) -> DataFrame:
    """Add erfc of a DOUBLE column; NaN stays.  Shared parts are columns of their own, so the generated code stays small."""
    df = df.withColumn("_e_x", argument).withColumn("_e_y", F.abs("_e_x")).withColumn("_e_q", F.floor(F.col("_e_y") * 16) / 16.0)
    df = df.withColumn("_e_f", F.exp(-F.col("_e_q") * F.col("_e_q")) * F.exp(-(F.col("_e_y") - F.col("_e_q")) * (F.col("_e_y") + F.col("_e_q"))))
    df = df.withColumn("_e_w", F.when(F.col("_e_y") > 4, 1.0 / (F.col("_e_y") * F.col("_e_y"))).when(F.col("_e_y") <= 0.46875, F.col("_e_x") * F.col("_e_x")).otherwise(F.col("_e_y")))
    far = F.col("_e_f") * (F.lit(_INV_SQRT_PI) - F.col("_e_w") * F.expr(_ratio(_P, _Q, "_e_w"))) / F.col("_e_y")
    df = df.withColumn("_e_u", F.when(F.col("_e_y") >= 26.6, 0.0).when(F.col("_e_y") > 4, far).when(F.col("_e_y") > 0.46875, F.col("_e_f") * F.expr(_ratio(_C, _D, "_e_w"))).otherwise(F.col("_e_x") * F.expr(_ratio(_A, _B, "_e_w"))))
    value = F.when(F.isnan("_e_x"), F.col("_e_x")).when(F.col("_e_y") <= 0.46875, 1 - F.col("_e_u")).when(F.col("_e_x") < 0, 2 - F.col("_e_u")).otherwise(F.col("_e_u"))
    return df.withColumn(name, value).drop("_e_x", "_e_y", "_e_q", "_e_f", "_e_w", "_e_u")


def log2_ratio(top: Column, bottom: Column) -> Column:
    """log2(top / bottom) as IEEE has it: 0/0 and negatives NaN, x/0 and 0/x signed infinities."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    odd = F.isnan(top) | F.isnan(bottom) | ((top == 0) & (bottom == 0))
    safe = F.when((top > 0) & (bottom > 0), F.log2(F.when((top > 0) & (bottom > 0), top).otherwise(1.0) / F.when(bottom > 0, bottom).otherwise(1.0)))
    return F.when(odd, nan).when(bottom == 0, F.when(top > 0, inf).otherwise(-inf)).when(top == 0, F.when(bottom > 0, -inf).otherwise(inf)).when((top > 0) == (bottom > 0), F.when(top > 0, safe).otherwise(F.log2(F.abs(F.when((top < 0) & (bottom < 0), top / bottom).otherwise(1.0))))).otherwise(nan)


def log1p_ieee(x: Column) -> Column:
    """log1p with NaN below -1 and -inf at -1, where Spark's gives null."""
    return F.when(x < -1, F.lit(float("nan"))).when(x == -1, F.lit(float("-inf"))).otherwise(F.log1p(F.when(x > -1, x).otherwise(0.0)))


def upper_quantile(level: float) -> float:
    """The standard normal value exceeded with probability ``level``, by the lower tail: full precision for small levels."""
    return 0.0 - NormalDist().inv_cdf(level)
