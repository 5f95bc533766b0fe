"""The parts of the rank test alone: adjusted p-values, filters, fold changes, shifts, options, places."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.special import log1p_ieee, log2_ratio, upper_quantile, with_erfc
from rankloom.operators import normalize, ranks, statistics
from rankloom.operators.shift import answers
from rankloom.plans import spec
from rankloom.sources import places
from rankloom.sources.matrix import collapse_reference, from_table, noncount_signal, numbered

INF, NAN = float("inf"), float("nan")


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("p, want", [([0.01, INF, 0.5, -INF], [0.02, 1, 2 / 3, 0]), ([0.5] * 4, [0.5] * 4), ([0.01, NAN, 0.5], [0.02, NAN, 0.5]), ([], [])])
def test_adjusted(spark, p, want):
    df = statistics.adjusted(column(spark, p).withColumn("target", F.lit("t")), {"x": "q"})
    assert values(df, "q") == pytest.approx(want, nan_ok=True)


def test_families_are_apart(spark):
    df = spark.createDataFrame([(0, "g0", 0.1), (1, "g2", 0.5), (2, "g2", 0.9)], "i int, target string, x double")
    assert values(statistics.adjusted(df, {"x": "q"}), "q") == pytest.approx([0.1, 0.9, 0.9])


@pytest.mark.parametrize("t, r, threshold, want", [([0, 2, 0], [1.5, 0, 0], 1, [True, True, False]), ([-5, -0.1], [-9, -2], -1, [True, True]), ([0, 1], [0, 0], 0, [False, True]), ([NAN, NAN], [2, NAN], 1, [True, False])])
def test_filter(spark, t, r, threshold, want):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, r))], "i int, t double, r double")
    assert values(df.withColumn("keep", statistics.passes(F.col("t"), F.col("r"), threshold)), "keep") == want


def test_effect_and_fold_change(spark):
    df = spark.createDataFrame([(0, 20.0, 4, 5), (1, 0.0, 4, 5), (2, 10.0, 4, 5), (3, 0.0, 0, 5)], "i int, u double, m long, n long")
    assert values(df.withColumn("e", statistics.effect(F.col("u"), F.col("m"), F.col("n"))), "e") == pytest.approx([1, -1, 0, NAN], nan_ok=True)
    pairs = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (8.0, 2.0), (-8.0, -2.0), (-1.0, 2.0), (NAN, 1.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    assert values(df.withColumn("l", log2_ratio(F.col("a"), F.col("b"))), "l") == pytest.approx([NAN, INF, -INF, 2, 2, NAN, NAN], nan_ok=True)


def test_special_functions(spark):
    xs = [float(x) for x in np.r_[np.linspace(-8, 28, 400), 0.46875, 4.0, 1e-300]] + [INF, -INF, NAN]
    found = values(with_erfc(column(spark, xs), F.col("x"), "e"), "e")
    assert found == pytest.approx([math.erfc(x) for x in xs], rel=1e-12, abs=1e-300, nan_ok=True)
    assert values(column(spark, [-2.0, -1.0, 0.0, 3.0]).withColumn("l", log1p_ieee(F.col("x"))), "l") == pytest.approx([NAN, -INF, 0, math.log(4)], nan_ok=True)
    for level in (0.5, 0.025, 0.05):
        assert upper_quantile(level) == pytest.approx(-NormalDist().inv_cdf(level), abs=1e-12)


@pytest.mark.parametrize("totals, want", [([0, 10, 20, 30], 20), ([0, 0, 4, 8], 6), ([7], 7)])
def test_median_of_positive_totals(spark, totals, want):
    assert normalize.resolve_total("median", column(spark, [float(t) for t in totals]).withColumnRenamed("x", "library")) == want


def test_median_without_positive_totals(spark):
    with pytest.raises(ValueError):
        normalize.resolve_total("median", column(spark, [0.0]).withColumnRenamed("x", "library"))


def test_cubes_are_exact(spark):
    most = ranks.CUBE_LIMIT
    row = spark.range(1).select(ranks.cubed(F.lit(416135), False).alias("a"), ranks.cubed(F.lit(most), False).alias("b"), ranks.cubed(F.lit(50 * most), True).alias("c")).first()
    assert [int(x) for x in row] == [c**3 - c for c in (416135, most, 50 * most)]


@pytest.mark.parametrize("t, r, want", [([7], [0, 0, 5], INF), ([0], [0, 0, 5], -INF), ([0] * 5, [0] * 8, NAN)])
def test_shift_beyond_reach(t, r, want):
    assert shift(t, r, (0.5,)) == pytest.approx([want], nan_ok=True)


def shift(t, r, levels, se=False):
    (tv, tc), (rv, rc) = (np.unique(np.array(v, float), return_counts=True) for v in (t, r))
    return answers(tv, tc, rv, rc, levels, se)


@pytest.mark.parametrize("t, r, want", [([0], [1], (-INF, INF)), ([0, 0, 0], [1, 2, 3, 5], (-INF, -INF)), ([0, 0], [1, 2], (-INF, INF)), ([3, 9], [0] * 4, (-INF, INF)), ([3, 9, 5, 7, 2, 8], [0] * 8, (INF, INF))])
def test_infinite_bounds(t, r, want):
    assert shift(t, r, (0.5,), True)[1:] == [*want, INF]


def test_finite_bounds():
    _, low, high, width = shift([50, 60, 70, 80], [1, 1, 2, 2], (0.5,), True)
    assert (low, high) == pytest.approx((4.644, 6.322), abs=2e-3) and math.isfinite(width)


def test_shift_is_where_u_crosses():
    """Against a scan of all log-ratios of a target to a reference value, where U changes."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        t, r = rng.lognormal(1, 1, 9), rng.lognormal(0, 1, 12)
        found = shift(t, r, (0.5,))[0]
        cuts = np.sort(np.log2(t[:, None] / r).ravel())
        u = lambda s: sum((t[:, None] * 2.0**-s > r).ravel())  # noqa: E731, B023
        level = 54 + (0.5 if u(0) >= 54 else -0.5)
        middles = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
        above = np.array([u(s) > level if level < 54 else u(s) >= level for s in middles])
        assert found == pytest.approx(cuts[above.sum() - 1], abs=1e-6)


@pytest.mark.parametrize("options, error", [
    ({"archive": "a", "shard_archive": "b"}, ValueError), ({}, ValueError), ({"adata": 1, "archive": "a"}, ValueError), ({"cell_source": 1, "reference": "ntc"}, ValueError), ({"adata": 1, "min_feature_filter": None}, ValueError),
    ({"adata": 1, "mean_calc": "mean"}, ValueError), ({"adata": 1, "epsilon": -1.0}, ValueError), ({"adata": 1, "epsilon": NAN}, ValueError), ({"adata": 1, "gpu_gene_chunk_size": True}, ValueError), ({"adata": 1, "lfc_threshold": 31}, ValueError),
    ({"adata": 1, "lfc_threshold": (1, 1.0)}, ValueError), ({"adata": 1, "lfc_threshold": (1, 1 + 1e-9)}, ValueError), ({"adata": 1, "lfc_threshold": 1, "lfc_threshold_alt": "sideways"}, ValueError), ({"adata": 1, "tau_star": 1.0}, ValueError),
    ({"adata": 1, "tau_star_se": True}, ValueError), ({"adata": 1, "tau_star": 0.5, "tau_star_iters": 0}, ValueError), ({"adata": 1, "tau_star": 0.5, "tau_star_se": 1}, ValueError), ({"adata": 1, "reference": spec.ALL_OTHERS, "tau_star": 0.5}, NotImplementedError),
    ({"adata": 1, "cpm_normalize": True, "normalize_target_sum": 1e4}, ValueError), ({"adata": 1, "cpm_normalize": 1}, ValueError), ({"adata": 1, "normalize_target_sum": 0}, ValueError), ({"adata": 1, "output_columns": {}}, ValueError),
    ({"adata": 1, "output_columns": {"nope": "x"}}, KeyError), ({"adata": 1, "output_columns": {"target": "x", "feature": "x"}}, ValueError)])
def test_options_that_are_refused(options, error):
    with pytest.raises(error):
        spec.checked(**options)


def test_names_and_factors():
    with pytest.warns(DeprecationWarning):
        assert spec.checked(shard_archive="a")[0] == "a"
    grid = spec.tau_grid((1, 0, 0.5), ("down", "up"))
    assert [spec.tau_names(*g)[0] for g in grid] == ["tau=+0_p", "tau=-0_p", "tau=+0.5_p", "tau=-0.5_p", "tau=+1_p", "tau=-1_p"]
    assert [spec.scale_factor(*g) for g in ((1, "up"), (1, "down"), (2, "up"))] == [0.5, 2.0, 0.25]
    assert spec.shift_names(spec.shift_levels(0.05, True), True) == ["tau*_p0.05", "tau*_p0.5", "tau*_lo_p0.025", "tau*_hi_p0.025", "tau*_se"]


def test_matrix_adapters(spark):
    table = spark.createDataFrame([(1, "b", 2.0), (1, "b", 3.0), (2, "a", -1.0), (2, "c", None)], "cell int, gene string, n double")
    m = from_table(table, "cell", "gene", "n")
    assert [tuple(r) for r in m.genes.orderBy("gene_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert {tuple(r) for r in normalize.canonical(m.entries).collect()} == {(1, 1, 5.0), (2, 0, -1.0)}
    assert noncount_signal(m.entries) and not noncount_signal(m.entries.where("value > 0"))
    assert m.same_genes(m) and not m.same_genes(from_table(table.where("gene <> 'a'"), "cell", "gene", "n"))
    assert sorted(r.k for r in numbered(spark.range(1000), "id", "k").where("k = id").collect()) == list(range(1000))
    names = values(column(spark, ["ntc_1", "a_ntc"], "string").withColumn("l", collapse_reference(F.col("x"), "ntc", "ntc")), "l")
    assert names == ["ntc", "a_ntc"]


def test_tables_are_stored_in_small_parts(spark):
    """However large the session lets parts be: 30 MB or so are put together by a shuffle, then read from files."""
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    alone = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.files.minPartitionNum": "1"}  # what else keeps parts small here
    spark.conf.set(sizes[0], "128MB")
    for name, value in alone.items():
        spark.conf.set(name, value)
    try:
        table = spark.range(2_000_000).withColumn("x", F.rand(1))
        dealt = places.stored(table.repartition("id"))
        again = places.stored(dealt.withColumn("y", F.col("x") * 2))
        for df in (dealt, again):
            largest = df.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
            assert largest < 1_000_000
        assert (again.count(), again.agg(F.sum("id")).first()[0]) == (2_000_000, 1_999_999_000_000)
        assert (spark.conf.get(sizes[0]), spark.conf.get(sizes[1], None)) == ("128MB", None)
        spark.conf.set(sizes[1], "16k")
        with pytest.raises(ZeroDivisionError), places.small_parts(spark):
            assert [places._bytes(spark.conf.get(s)) for s in sizes] == [places.PART_BYTES, 16 << 10]
            1 / 0
        assert [spark.conf.get(s) for s in sizes] == ["128MB", "16k"]
    finally:
        for name in (*sizes, *alone):
            spark.conf.unset(name)
