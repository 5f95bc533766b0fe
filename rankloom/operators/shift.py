"""The log2 shift at which a one-sided test crosses a level, with bounds and standard error.

As the target is divided by 2**s, U falls in steps: by the cells of a pair of positive values each
time s passes the log-ratio of the two.  The shift at which U leaves a level is therefore an order
statistic of those log-ratios, and is found exactly, by weighted selection that never forms the
pairs.  Genes are independent; a task has one gene's reference histogram and a slice of groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import TINY, upper_quantile
from ..plans.spec import SE_LEVEL, shift_names

#: Groups that share one copy of a gene's reference histogram.
GROUPS_PER_SLICE = 64


def _larger(top: np.ndarray, bottom: np.ndarray, pivot: float, equal: bool) -> np.ndarray:
    """For each of ``top``, how many of the rising ``bottom`` it exceeds ``pivot`` times (``equal``: or just so)."""
    low, high = np.zeros(len(top), np.int64), np.full(len(top), len(bottom), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        ratio = top / bottom[np.minimum(middle, len(bottom) - 1)]
        yes = open_ & ((ratio >= pivot) if equal else (ratio > pivot))
        low, high = np.where(yes, middle + 1, low), np.where(open_ & ~yes, middle, high)
    return low


def ratio_of_rank(top: np.ndarray, tops: np.ndarray, bottom: np.ndarray, bottoms: np.ndarray, rank: int) -> float:
    """The ``rank``-th largest of all ratios of two positive values, each pair as often as the product of its counts.

    Of each ``top`` the ratios that may still be the answer are a run over the rising ``bottom``.
    A pivot that lies in the middle of the runs' middles leaves at most three quarters of them.
    """
    upto = np.r_[0, np.cumsum(bottoms)]
    first, last = np.zeros(len(top), np.int64), np.full(len(top), len(bottom), np.int64)
    while True:
        left = np.flatnonzero(first < last)
        middles = top[left] / bottom[(first[left] + last[left]) // 2]
        order = np.argsort(middles, kind="stable")
        weight = np.cumsum((last - first)[left][order])
        pivot = float(middles[order[np.searchsorted(weight, weight[-1] / 2)]])
        above, from_ = _larger(top, bottom, pivot, False), _larger(top, bottom, pivot, True)
        if rank <= int((tops * upto[above]).sum()):
            last = np.minimum(last, above)
        elif rank > int((tops * upto[from_]).sum()):
            first = np.maximum(first, from_)
        else:
            return pivot


def answers(tv: np.ndarray, tc: np.ndarray, rv: np.ndarray, rc: np.ndarray, levels: tuple[float, ...], se: bool) -> list[float]:
    """One value for each name of ``shift_names``, from rising values with counts.

    NaN without cells on a side, with zeros alone on both, or with a value below zero.
    """
    names, tc, rc = shift_names(levels, se), tc.astype(np.int64), rc.astype(np.int64)
    m, n = int(tc.sum()), int(rc.sum())
    t, r = tv > 0, rv > 0
    if not m or not n or not (t.any() or r.any()) or tv[0] < 0 or rv[0] < 0:
        return [math.nan] * len(names)
    zeros = int(tc[~t].sum()), int(rc[~r].sum())
    pairs = (m - zeros[0]) * (n - zeros[1])
    fixed = zeros[1] * (m - zeros[0]) + zeros[0] * zeros[1] / 2  # U from pairs that no shift changes
    # Between the steps only zeros tie across the two sides.
    runs = [sum(zeros), *map(int, tc[t]), *map(int, rc[r])]
    tie, total, middle = sum(c**3 - c for c in runs), m + n, m * n / 2
    sigma = math.sqrt(max(m * n / 12 * (total + 1 - tie / max(total * (total - 1), 1)), TINY))

    def leaves(level: float, up: bool) -> float:
        """Where U falls below the level (up), or to it (down)."""
        rank = math.ceil(level - fixed) if up else math.floor(level - fixed) + 1
        if not 0 < rank <= pairs:
            return math.inf if rank <= 0 else -math.inf
        return math.log2(ratio_of_rank(tv[t], tc[t], rv[r], rc[r], rank))

    below = np.r_[0, np.cumsum(rc)]
    u = (tc * (below[np.searchsorted(rv, tv)] + below[np.searchsorted(rv, tv, "right")])).sum() / 2
    up = bool(u >= middle)
    found = [leaves(middle + (0.5 + upper_quantile(q) * sigma) * (1 if up else -1), up) for q in levels]
    if se:
        z = upper_quantile(SE_LEVEL)
        low, high = leaves(middle + 0.5 + z * sigma, True), leaves(middle - 0.5 - z * sigma, False)
        found += [low, high, (high - low) / (2 * z) if math.isfinite(low) and math.isfinite(high) else math.inf]
    return found


def shifts(hist: DataFrame, levels: tuple[float, ...], se: bool, groups: int) -> DataFrame:
    """``(group, gene_idx, shift)``, ``shift`` an array in the order of ``shift_names``; ``groups`` is how many targets there are.

    A gene's reference histogram has at most as many rows as the reference has distinct values.
    """
    slices = max(1, -(-groups // GROUPS_PER_SLICE))
    target = hist.where("side = 0").select("gene_idx", F.pmod(F.xxhash64("group"), F.lit(slices)).alias("slice"), "group", "v", "n")
    reference = hist.where("side = 1").groupBy("gene_idx", "v").agg(F.sum("n").alias("n"))
    reference = reference.withColumn("slice", F.explode(F.expr(f"sequence(0L, {slices - 1}L)"))).select(*(F.col(c).alias(c) for c in ("gene_idx", "slice", "v", "n")))  # names of its own, for the cogroup

    def solve(own: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        ref = ref.sort_values("v")
        rows = []
        for (gene, group), part in own.sort_values("v").groupby(["gene_idx", "group"], sort=False, dropna=False):
            rows.append((group, gene, answers(part["v"].to_numpy(), part["n"].to_numpy(), ref["v"].to_numpy(), ref["n"].to_numpy(), levels, se)))
        return pd.DataFrame(rows, columns=["group", "gene_idx", "shift"])

    return target.groupBy("gene_idx", "slice").cogroup(reference.groupBy("gene_idx", "slice")).applyInPandas(solve, "group string, gene_idx int, shift array<double>")
