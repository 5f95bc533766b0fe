"""The whole test against every pair of values, for each source and option."""

import math
import warnings

import numpy as np
import pytest

import rankloom
from rankloom import ALL_OTHERS, CellGroup, de
from rankloom.api import empty_result
from rankloom.plans.spec import Spec
from rankloom.operators import compare
from rankloom.sources.archive import open_archive, write_archive
from rankloom.sources.matrix import from_dense

RNG = np.random.default_rng(7)
LABELS = ["ntc"] * 14 + ["b"] * 9 + ["a"] * 6 + ["lone"]
VALUES = RNG.negative_binomial(2, 0.4, (30, 6)).astype(float)
VALUES[:, 3] = 0
VALUES[4] = 0
VALUES[:, 4] *= 1.25


def p_of(most, m, n, tie):
    spread = math.sqrt(max(m * n / 12 * (m + n + 1 - tie / max((m + n) * (m + n - 1), 1)), 2.2250738585072014e-308))
    return math.erfc((most - m * n / 2 - 0.5) / spread / math.sqrt(2))


def u_and_tie(t, r):
    u = sum(float(b < a) + 0.5 * float(b == a) for a in t for b in r)
    _, counts = np.unique(np.r_[t, r], return_counts=True)
    return u, float((counts.astype(float) ** 3 - counts).sum())


def bh(p):
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, least = [0.0] * len(p), 1.0
    for place in range(len(p), 0, -1):
        i = order[place - 1]
        least = min(least, p[i] * len(p) / place)
        out[i] = least
    return out


def plain(values, labels, reference, total=None, geometric=False, taus=(), epsilon=1e-9, keep=None):
    values, labels = np.asarray(values, float), np.asarray(labels)
    library = values.sum(1)
    x = values.astype(np.float32)
    if total is not None:
        x = x * (total / np.where(library == 0, 1, library)).astype(np.float32)[:, None]
    x, out = x.astype(float), {}
    for g in sorted(set(labels) - {reference}):
        mine, other = labels == g, labels != g if reference == ALL_OTHERS else labels == reference
        rows = {}
        for j in range(x.shape[1]):
            t, r = x[mine, j], x[other, j]
            if keep is not None and not keep(values[mine, j], values[other, j], library[mine], library[other], j):
                continue
            u, tie = u_and_tie(t, r)
            m, n = len(t), len(r)
            mean = (lambda v: math.expm1(np.log1p(v).mean())) if geometric else np.mean
            row = [mean(t), mean(r), m, n, math.log2((mean(t) + epsilon) / (mean(r) + epsilon)), min(max(p_of(max(u, m * n - u), m, n, tie), 0), 1), 2 * u / (m * n) - 1]
            for tau, way in taus:
                u, tie = u_and_tie(t * 2.0 ** (-tau if way == "up" else tau), r)
                row += [0.5 * p_of(u if way == "up" else m * n - u, m, n, tie), 2 * u / (m * n) - 1]
            rows[j] = row
        for column in (5, *range(7, 7 + 2 * len(taus), 2)):
            for j, q in zip(rows, bh([row[column] for row in rows.values()])):
                rows[j].append(q)
        out |= {(g, f"g{j}"): row for j, row in rows.items()}
    return out


def got(result, taus=()):
    names = [f"tau={'+' if d == 'up' else '-'}{t:g}" for t, d in taus]
    columns = ["target_mean", "ref_mean", "target_ncells", "ref_ncells", "log2_fold_change", "p_value", "Ueffect", *(f"{n}{e}" for n in names for e in ("_p", "_Ueffect")), "p_adj", *(f"{n}_padj" for n in names)]
    return {(r["target"], r["feature"]): [r[c] for c in columns] for r in result.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in b:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12), k


@pytest.fixture(scope="module")
def matrix(spark):
    return from_dense(spark, VALUES, {"guide": LABELS})


@pytest.mark.parametrize("options", [{}, {"total": 50.0}, {"geometric": True}, {"epsilon": 0.5}])
def test_reference_label(matrix, options):
    call = {"normalize_target_sum": options.get("total"), "mean_calc": "geometric" if "geometric" in options else "arithmetic", "epsilon": options.get("epsilon", 1e-9)}
    same(got(de(matrix, groupby="guide", reference="ntc", **call)), plain(VALUES, LABELS, "ntc", **options))


def test_all_others_and_its_old_name(matrix):
    want = plain(VALUES, LABELS, ALL_OTHERS)
    with pytest.warns(DeprecationWarning):
        same(got(de(matrix, groupby="guide", reference="all_others")), want)


def test_one_group_against_nobody(spark):
    only = de(from_dense(spark, VALUES, {"guide": ["x"] * 30}), groupby="guide", reference=ALL_OTHERS).collect()
    assert len(only) == 6 and all(r.ref_ncells == 0 and math.isfinite(r.p_value) and math.isnan(r.Ueffect) for r in only)


def test_tau_grid_leaves_the_rest_alone(matrix):
    taus = [(0.0, "up"), (0.0, "down"), (0.5, "up"), (0.5, "down")]
    same(got(de(matrix, groupby="guide", reference="ntc", lfc_threshold=(0.5, 0)), taus), plain(VALUES, LABELS, "ntc", taus=taus))


@pytest.mark.parametrize("name, keep", [
    ("mean_value", lambda t, r, lt, lr, j: t.mean() > 3.2 or r.mean() > 3.2),
    ("total_value", lambda t, r, lt, lr, j: t.sum() > 50 or r.sum() > 50),
    ("cpm_cell", lambda t, r, lt, lr, j: max((v * (1e6 / np.where(x == 0, 1, x)).astype(np.float32).astype(float)).mean() for v, x in ((t, lt), (r, lr))) > 180_000),
    ("cpm_bulk", lambda t, r, lt, lr, j: max(v.sum() / np.where(x == 0, 1, x).sum() * 1e6 for v, x in ((t, lt), (r, lr))) > 190_000)])
def test_filters_shrink_the_family(matrix, name, keep):
    threshold = {"mean_value": 3.2, "total_value": 50, "cpm_cell": 180_000, "cpm_bulk": 190_000}[name]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        result = de(matrix, groupby="guide", reference="ntc", **{f"filter_gene_min_{name}": threshold})
    want = plain(VALUES, LABELS, "ntc", keep=keep)
    assert 0 < len(want) < 18
    same(got(result), want)


def test_mask(matrix):
    mask = np.array([True, False, True, False, False, True])
    same(got(de(matrix, groupby="guide", reference="ntc", keep_genes=mask)), plain(VALUES, LABELS, "ntc", keep=lambda *a: mask[a[-1]]))
    for bad in ([1, 0, 1, 0, 0, 1], [True]):
        with pytest.raises(ValueError):
            de(matrix, groupby="guide", reference="ntc", keep_genes=bad)


def test_pool_archive_and_own_source_agree(spark, tmp_path, matrix):
    want = plain(VALUES, LABELS, "ntc")
    labels = np.array(LABELS)
    targets = from_dense(spark, VALUES[14:], {"guide": LABELS[14:]})
    pool = from_dense(spark, VALUES[:14])
    same(got(de(targets, groupby="guide", reference=pool)), want)
    for layout in ("shard", "cell"):
        path = f"file://{tmp_path}/{layout}"
        write_archive(matrix, path, "guide", "ntc", layout)
        same(got(de(archive=path, spark=spark)), want)
        with pytest.raises(ValueError):
            de(archive=path, reference="a", spark=spark)
        with pytest.raises(ValueError):
            de(archive=path, groupby="other", spark=spark)
    groups = [CellGroup("b", VALUES, np.flatnonzero(labels == "b")), CellGroup("lone", VALUES[29:]), CellGroup("a", VALUES[labels == "a"])]
    own = {"targets": ["a", "b", "lone"], "var_names": [f"g{j}" for j in range(6)], "reference": VALUES[:14], "spark": spark}
    same(got(de(cell_source=lambda: iter(groups), **own)), want)
    for bad in (groups[:2], groups + groups[:1], [CellGroup("strange", VALUES), *groups]):
        with pytest.raises(ValueError):
            de(cell_source=lambda bad=bad: iter(bad), **own)
    with pytest.raises(TypeError):
        de(cell_source=lambda: iter([CellGroup("a", VALUES, labels == "a")]), **own)


def test_archives_are_read_in_part_and_checked(spark, tmp_path, matrix):
    want = plain(VALUES, LABELS, "ntc")
    for layout in ("shard", "cell"):
        path = f"file://{tmp_path}/{layout}"
        write_archive(matrix, path, "guide", "ntc", layout)
        some = de(archive=path, targets=["b", "a"], ordered=True, spark=spark)
        same(got(some), {k: v for k, v in want.items() if k[0] in ("a", "b")})
        assert [(r.target, r.feature) for r in some.collect()] == [(t, f"g{j}") for t in ("b", "a") for j in range(6)]
        archive = open_archive(spark, path)
        files = {r[0].split("/")[-1] for r in archive.index.where("group = 'b'").select("file").collect()}
        assert {f.split("/")[-1] for f in archive.matrix(["b"]).entries.inputFiles()} == files
        with pytest.raises(ValueError, match="no cells"):
            de(archive=path, targets=["absent"], spark=spark)
    cells = spark.read.parquet(f"{path}/cells")
    cells.unionByName(cells.limit(1)).write.parquet(f"file://{tmp_path}/more")
    spark.read.parquet(f"file://{tmp_path}/more").write.mode("overwrite").parquet(f"{path}/cells")
    with pytest.raises(ValueError, match="rows"):
        de(archive=path, spark=spark)


def test_order_of_rows(spark, matrix):
    rows = [(r.target, r.feature) for r in de(matrix, groupby="guide", reference="ntc", ordered=True).collect()]
    assert rows == [(t, f"g{j}") for t in ("a", "b", "lone") for j in range(6)]


def test_source_is_read_once(spark, tmp_path):
    """Only the first job's plan names the source's files; the result reads what was stored."""
    rows = [(i, j, float(VALUES[i, j])) for i in range(30) for j in range(6) if VALUES[i, j]]
    spark.createDataFrame(rows, "cell_id long, gene_idx int, value double").write.parquet(f"file://{tmp_path}/src")
    base = from_dense(spark, VALUES, {"guide": LABELS})
    result = de(rankloom.CountMatrix(spark.read.parquet(f"file://{tmp_path}/src"), base.cells, base.genes), groupby="guide", reference="ntc", lfc_threshold=0.5)
    assert f"{tmp_path}/src" not in result._jdf.queryExecution().executedPlan().toString()
    assert len(got(result)) == 18


def test_results_are_compared(spark, matrix):
    a, b = de(matrix, groupby="guide", reference="ntc"), de(matrix, groupby="guide", reference="ntc", normalize_target_sum=50.0).where("target <> 'lone'")
    assert tuple(compare.coverage(a, b).first()) == (12, 6, 0)
    found = {r["column"]: r for r in compare.correlations(a, b).collect()}
    rows = {(r.target, r.feature): r for r in a.collect()}
    pairs = [(rows[r.target, r.feature].p_value, r.p_value) for r in b.collect()]
    x, y = (np.array(v) for v in zip(*pairs))

    def rank(v):
        return np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])

    r = found["p_value"]
    assert (r.n, r.pearson, r.spearman, r.largest) == pytest.approx((12, np.corrcoef(x, y)[0, 1], np.corrcoef(rank(x), rank(y))[0, 1], abs(x - y).max()))


def test_group_without_cells(spark):
    own = {"targets": ["none"], "var_names": ["g0", "g1"], "reference": np.ones((3, 2)), "spark": spark}
    rows = de(cell_source=lambda: iter([CellGroup("none", np.ones((2, 2)), [])]), **own).collect()
    assert len(rows) == 2 and all(r.target_ncells == 0 and math.isnan(r.p_value) and math.isnan(r.Ueffect) for r in rows)


def test_columns_and_empty_schema(matrix):
    renamed = de(matrix, groupby="guide", reference="ntc", output_columns={"feature": "gene", "target": "feature"})
    assert renamed.columns == ["gene", "feature"]
    whole = de(matrix, groupby="guide", reference="ntc", tau_star=0.5, tau_star_se=True, lfc_threshold=1)
    empty = empty_result(matrix.cells.sparkSession, Spec(taus=((1.0, "up"), (1.0, "down")), levels=(0.5,), se=True))
    assert whole.dtypes == empty.dtypes and empty.isEmpty()


def test_missing_labels_and_unknown_reference(spark):
    with pytest.raises(ValueError):
        de(from_dense(spark, VALUES, {"guide": [None, *LABELS[1:]]}), groupby="guide", reference="ntc")
    with pytest.raises(ValueError):
        de(from_dense(spark, VALUES, {"guide": LABELS}), groupby="guide", reference="absent")
    fine = from_dense(spark, VALUES[:, :1], {"guide": ["", "nan_cluster", *LABELS[2:]]})
    assert {r.target for r in de(fine, groupby="guide", reference="ntc").collect()} == {"", "nan_cluster", "a", "b", "lone"}


def test_public_names():
    assert set(rankloom.__all__) == {"ALL_OTHERS", "CellGroup", "CountMatrix", "MeanCalc", "de", "__version__"}
