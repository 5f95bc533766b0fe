"""Sources beyond a matrix in memory: prepared references, callables, archives, arrivals."""

import os
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import ALL_OTHERS, CellGroup, de
from rankloom.api import _from_source
from rankloom.operators import normalize
from rankloom.plans.spec import Spec
from rankloom.sources import places
from rankloom.sources.archive import open_archive, write_archive
from rankloom.sources.groups import from_groups
from rankloom.sources.matrix import CountMatrix, from_dense
from rankloom.sources.reference import open_reference, prepare
from rankloom.streaming.arrivals import arrivals, results, watch

RNG = np.random.default_rng(3)
POOL = RNG.negative_binomial(2, 0.3, (40, 5)).astype(float)
TARGETS = RNG.negative_binomial(2, 0.35, (30, 5)).astype(float)
POOL[:, 2] = 0
TARGETS[3] = 0
LABELS = ["b"] * 14 + ["a"] * 10 + ["é"] * 6


def rows(df):
    return {(r["target"], r["feature"]): [r[c] for c in df.columns if c not in ("target", "feature")] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in b:
        assert a[k] == pytest.approx(b[k], rel=1e-12, nan_ok=True), k


@pytest.fixture(scope="module")
def pool(spark):
    return from_dense(spark, POOL)


@pytest.fixture(scope="module")
def targets(spark):
    return from_dense(spark, TARGETS, {"guide": LABELS})


# ---------------------------------------------------------------- prepared references


@pytest.mark.parametrize("options", [{"lfc_threshold": (0, 0.5), "tau_star": 0.3, "tau_star_se": True}, {"normalize_target_sum": 50.0, "mean_calc": "geometric", "filter_gene_min_cpm_cell": 150_000}, {"filter_gene_min_cpm_bulk": 190_000, "filter_gene_min_total_value": 3, "keep_genes": [True, False, True, True, True]}])
def test_prepared_pool_gives_the_pools_results(spark, tmp_path, pool, targets, options):
    made = prepare(pool, f"file://{tmp_path}/pool", options.get("normalize_target_sum"))
    want = rows(de(targets, groupby="guide", reference=pool, **options))
    assert want
    same(rows(de(targets, groupby="guide", reference=open_reference(spark, made.path), **options)), want)


def test_prepared_pool_is_not_read_or_shuffled_again(spark, tmp_path, targets):
    base = from_dense(spark, POOL)
    base.entries.write.parquet(f"file://{tmp_path}/entries")
    made = prepare(CountMatrix(spark.read.parquet(f"file://{tmp_path}/entries"), base.cells, base.genes), f"file://{tmp_path}/pool")
    shutil.rmtree(f"{tmp_path}/entries")
    for part in ("cells", "histogram"):
        shutil.rmtree(f"{tmp_path}/pool/{part}")
    same(rows(de(targets, groupby="guide", reference=made)), rows(de(targets, groupby="guide", reference=base)))
    from rankloom.operators import ranks

    hist = spark.createDataFrame([(0, "a", 0, 1.0, 2)], "side int, group string, gene_idx int, v double, n long")
    found = ranks.against_reference(hist, [1.0], False, made)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    (at,) = (i for i, line in enumerate(lines) if "Bucketed: true" in line)
    above = []  # what stands over the scan, up to where targets join it
    depth = re.search("[A-Z]", lines[at]).start()
    while not above or not above[-1].startswith("Union"):
        at -= 1
        if re.search("[A-Z]", lines[at]).start() < depth:
            depth = re.search("[A-Z]", lines[at]).start()
            above.append(lines[at][depth:])
    assert not any("Exchange" in line for line in above)


def test_prepared_pool_is_checked(spark, tmp_path, pool, targets):
    made = prepare(pool, f"file://{tmp_path}/pool", 50.0)
    with pytest.raises(ValueError, match="prepared for a target sum"):
        de(targets, groupby="guide", reference=made)
    with pytest.raises(ValueError, match="genes"):
        de(from_dense(spark, TARGETS[:, :4], {"guide": LABELS}), groupby="guide", reference=made, normalize_target_sum=50.0)
    with pytest.raises(ValueError, match="no cells"):
        prepare(CountMatrix(pool.entries.limit(0), pool.cells.limit(0), pool.genes), f"file://{tmp_path}/none")
    with pytest.raises(NotImplementedError):
        prepare(pool, f"file://{tmp_path}/median", "median")
    with pytest.raises(ValueError, match="not a prepared reference"):
        open_reference(spark, f"file://{tmp_path}/nowhere")


# ---------------------------------------------------------------- arrivals


def test_batches_share_one_reading_of_the_pool(spark, tmp_path, targets):
    base = from_dense(spark, POOL)
    base.entries.write.parquet(f"file://{tmp_path}/entries")
    made = prepare(CountMatrix(spark.read.parquet(f"file://{tmp_path}/entries"), base.cells, base.genes), f"file://{tmp_path}/pool")
    shutil.rmtree(f"{tmp_path}/entries")
    for n, label in enumerate(("a", "b", "é")):
        arrivals(targets, "guide").where(F.col("group") == label).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        watch(spark, f"file://{tmp_path}/in", made, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", Spec()).awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out/results").select("target").distinct().count() == n + 1
    same(rows(spark.read.parquet(f"file://{tmp_path}/out/results").drop("batch")), rows(de(targets, groupby="guide", reference=base)))


def test_groups_in_parts(spark, tmp_path, targets, pool):
    options, spec = {"normalize_target_sum": 50.0, "filter_gene_min_cpm_cell": 150_000}, Spec(total=50.0, filters={"cpm_cell": 150_000.0})
    rows_of = arrivals(targets, "guide")
    made = prepare(pool, f"file://{tmp_path}/pool", spec.total)
    place = {x: f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint")}
    ends = [0, 4, 17, 30]  # the fourth cell has no entries
    for n in range(3):
        rows_of.where(F.col("cell_id").between(ends[n], ends[n + 1] - 1)).coalesce(1).write.mode("append").parquet(place["in"])
        watch(spark, place["in"], made, place["out"], place["checkpoint"], spec).awaitTermination()
        assert spark.read.parquet(place["out"] + "/groups").count() == (1, 3, 5)[n]  # groups that a batch touched
    want = rows(results(spark, place["out"]))
    same(want, rows(de(targets, groupby="guide", reference=pool, **options)))
    for left in (f"{tmp_path}/checkpoint/commits/2", f"{tmp_path}/checkpoint/commits/.2.crc"):
        if os.path.exists(left):
            os.remove(left)  # the last batch is done again, as after a crash
    watch(spark, place["in"], made, place["out"], place["checkpoint"], spec).awaitTermination()
    same(rows(results(spark, place["out"])), want)
    rows_of.where("cell_id = 5").coalesce(1).write.mode("append").parquet(place["in"])
    with pytest.raises(Exception, match="arrived again"):
        watch(spark, place["in"], made, place["out"], place["checkpoint"], spec).awaitTermination()
    same(rows(results(spark, place["out"])), want)


def test_arrivals_without_entries_and_without_target(spark, tmp_path, targets, pool):
    alone = CountMatrix(targets.entries.where("cell_id = 3"), targets.cells.where("cell_id = 3"), targets.genes)
    arrivals(alone, "guide").write.parquet(f"file://{tmp_path}/in")
    watch(spark, f"file://{tmp_path}/in", pool, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    same(rows(results(spark, f"file://{tmp_path}/out")), rows(de(alone, groupby="guide", reference=pool)))
    with pytest.raises(ValueError, match="keep the target"):
        watch(spark, f"file://{tmp_path}/in", pool, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", Spec(output_columns={"p_value": "p"}))


# ---------------------------------------------------------------- filters


def test_filters_act_before_ranks(spark, tmp_path, monkeypatch):
    """One gene of a hundred passes: about as few values are ranked, on both sides and of a prepared pool."""
    from rankloom.operators import ranks

    rng, ranked = np.random.default_rng(8), []
    values = rng.negative_binomial(3, 0.2, (60, 100)).astype(float)
    values[:, 42] += 500
    labels = ["t0"] * 20 + ["t1"] * 20 + ["ref"] * 20
    matrix = from_dense(spark, values, {"guide": labels})
    placed = ranks.placed

    def counted(rows, keys, *args, **more):
        if keys == ["gene_idx"]:
            ranked.append(rows.count())
        return placed(rows, keys, *args, **more)

    monkeypatch.setattr(ranks, "placed", counted)
    targets, pool = (CountMatrix(matrix.entries.join(c, "cell_id", "left_semi"), c, matrix.genes) for c in (matrix.cells.where("guide <> 'ref'"), matrix.cells.where("guide = 'ref'")))
    made = prepare(pool, f"file://{tmp_path}/pool")
    few, mask = {"filter_gene_min_mean_value": 300}, {"keep_genes": [j == 42 for j in range(100)]}
    for source, reference, asked in ((matrix, "ref", (few, mask)), (matrix, ALL_OTHERS, (few,)), (targets, made, (few,))):
        shifts = {"tau_star": 0.4} if reference is made else {}
        counts = []
        for options in ({}, *asked):
            ranked.clear()
            found = rows(de(source, groupby="guide", reference=reference, **shifts, **options).drop("p_adj"))
            counts.append(sum(ranked))
            if options:
                assert {g for _, g in found} == {"g42"}
                same(found, {k: whole[k] for k in found})
            else:
                whole = found
        assert all(0 < c < counts[0] / 30 for c in counts[1:]), counts


# ---------------------------------------------------------------- archives


@pytest.mark.parametrize("layout", ["shard", "cell"])
def test_archive_index(spark, tmp_path, layout):
    names = ["", "1", "a b", "x/y=+%", "é"]
    labels = [names[i % 5] for i in range(30)]
    path = f"file://{tmp_path}/archive"
    write_archive(from_dense(spark, TARGETS, {"guide": labels}), path, "guide", ["1", "é"], layout, cells_per_file=4)
    archive = open_archive(spark, path)
    assert {tuple(r) for r in archive.groups.collect()} == {(n, 6, int(sum((TARGETS[i] != 0).sum() for i in range(30) if labels[i] == n)), n in ("1", "é")) for n in names}
    assert archive.largest() == 6
    for name in names:
        part = archive.matrix([name])
        assert {r[0] for r in part.cells.select("guide").distinct().collect()} == {name}
        assert part.entries.agg(F.sum("value")).first()[0] == sum(TARGETS[i].sum() for i in range(30) if labels[i] == name)
        own = {r.file: r.bytes for r in archive.index.where(F.col("group") == name).collect()}
        assert {os.path.basename(f) for f in part.entries.inputFiles()} == {os.path.basename(f) for f in own}
        assert sum(own.values()) <= sum(r[0] for r in archive.index.select("bytes", "file").distinct().collect()) / (2 if layout == "shard" else 1)


def test_damaged_archives(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    matrix = from_dense(spark, TARGETS, {"guide": LABELS})
    write_archive(matrix, path, "guide", "b", "shard")
    archive = open_archive(spark, path)
    files = {r.group: r.file for r in archive.index.collect()}
    os.remove(f"{tmp_path}/archive/entries/{files['a']}")
    assert archive.matrix(["b"]).entries.count() == (TARGETS[:14] != 0).sum()  # the file of another group
    for groups in (None, ["a"]):
        with pytest.raises(ValueError, match="missing|not as it was"):
            archive.matrix(groups)
    shutil.copy(f"{tmp_path}/archive/entries/{files['b']}", f"{tmp_path}/archive/entries/{files['a']}")
    with pytest.raises(ValueError, match="not as it was"):
        archive.matrix()
    with pytest.raises(ValueError, match="not an archive"):
        open_archive(spark, f"file://{tmp_path}/nothing")


def test_archives_are_checked_when_written(spark, tmp_path):
    matrix = from_dense(spark, TARGETS, {"guide": LABELS})
    for n, (bad, reference) in enumerate(((CountMatrix(matrix.entries, matrix.cells.unionByName(matrix.cells.limit(1)), matrix.genes), "b"), (CountMatrix(matrix.entries, matrix.cells.where("cell_id > 5"), matrix.genes), "b"), (matrix, "absent"), (from_dense(spark, TARGETS, {"guide": ["nan", *LABELS[1:]]}), "b"))):
        with pytest.raises(ValueError, match="repeat|do not exist|no cells|missing labels"):
            write_archive(bad, f"file://{tmp_path}/{n}", "guide", reference)
    write_archive(matrix, f"file://{tmp_path}/plain", None)
    assert open_archive(spark, f"file://{tmp_path}/plain").matrix().entries.count() == (TARGETS != 0).sum()
    with pytest.raises(ValueError, match="group_by"):
        de(archive=f"file://{tmp_path}/plain", spark=spark)


# ---------------------------------------------------------------- callables


def sparse_class():
    """A sparse matrix as far as groups need it; a local class, so that it travels with the source."""

    class Sparse:
        def __init__(self, array):
            self.array, self.shape = np.asarray(array), np.shape(array)
            self.row, self.col = np.nonzero(self.array)
            self.data = self.array[self.row, self.col]

        def tocoo(self):
            return self

        tocsr = tocoo

        def __getitem__(self, rows):
            return type(self)(self.array[rows])

    return Sparse


def test_many_groups_in_slices(spark):
    names = [f"t{i}" for i in range(2000)]

    def source(labels):  # made where it is read
        for label in labels:
            n = int(label[1:])
            yield CellGroup(label, np.full((n % 3, 4), n, np.int64))

    found = from_groups(spark, source, names, list("wxyz"))
    sums = {r["group"]: (r["n"], r["s"]) for r in found.cells.join(found.entries, "cell_id").groupBy("group").agg(F.countDistinct("cell_id").alias("n"), F.sum("value").alias("s")).collect()}
    assert sums == {f"t{i}": (i % 3, float(4 * i * (i % 3))) for i in range(2000) if i % 3}
    assert found.cells.count() == sum(i % 3 for i in range(2000)) == found.cells.select("cell_id").distinct().count()


def test_kinds_of_items_agree(spark, targets, pool):
    labels, Sparse = np.array(LABELS), sparse_class()
    want = rows(de(targets, groupby="guide", reference=pool))
    own = {"targets": ["é", "a", "b"], "var_names": [f"g{j}" for j in range(5)], "reference": pool, "spark": spark}
    kinds = {
        "dense": lambda: (CellGroup(x, TARGETS[labels == x]) for x in ("b", "a", "é")),
        "sparse": lambda: (CellGroup(x, Sparse(TARGETS), np.flatnonzero(labels == x)) for x in ("b", "a", "é")),
        "sliced": lambda asked: (CellGroup(x, TARGETS[labels == x]) for x in asked),
        "matrices": lambda: (CellGroup(x, from_dense(spark, TARGETS[labels == x])) for x in ("b", "a", "é")),
    }
    for kind, source in kinds.items():
        same(rows(de(cell_source=source, **own)), want)
    order = [r.target for r in de(cell_source=kinds["sliced"], ordered=True, **own).collect()]
    assert order == [t for t in own["targets"] for _ in range(5)]


@pytest.mark.parametrize("bad, error", [
    (lambda asked: (CellGroup(x, np.ones((2, 5))) for x in asked[1:]), ValueError),
    (lambda asked: (CellGroup(x, np.ones((2, 5))) for x in [*asked, *asked]), ValueError),
    (lambda asked: (CellGroup("strange", np.ones((2, 5))) for x in asked), ValueError),
    (lambda asked: (CellGroup(x, np.ones((2, 4))) for x in asked), ValueError),
    (lambda asked: (CellGroup(x, np.ones(5)) for x in asked), ValueError),
    (lambda asked: (CellGroup(x, np.ones((2, 5)), [0, 0]) for x in asked), ValueError),
    (lambda asked: (CellGroup(x, np.ones((2, 5)), [0.5]) for x in asked), TypeError),
    (lambda asked: (np.ones((2, 5)) for x in asked), TypeError)])
def test_sources_that_break_the_rules(spark, bad, error):
    with pytest.raises(error):
        from_groups(spark, bad, ["a", "b"], list("vwxyz"))


def test_cells_are_gathered_in_small_parts(spark, monkeypatch):
    """A source that yields matrices of the cluster: no task gathers more than a share of the cells, however large the session lets parts be."""
    monkeypatch.setattr(places, "PART_BYTES", 1 << 20, raising=False)
    genes = spark.createDataFrame([(j, f"g{j}") for j in range(2)], "gene_idx int, feature string")
    cells = spark.range(200_000).withColumnRenamed("id", "cell_id")
    entries = cells.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("gene_idx")).withColumn("value", 1 + F.rand(1))
    whole = CountMatrix(entries, cells, genes)
    study = _from_source(spark, lambda: (CellGroup(label, whole) for label in ("a", "b")), ["a", "b"], ["g0", "g1"], None, whole, Spec())
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    spark.conf.set(name, "false")
    try:
        rows = places.stored(normalize.gathered(study.entries, study.cells))
    finally:
        spark.conf.unset(name)
    parts = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert sum(parts) == 1_200_000 and max(parts) < 400_000
