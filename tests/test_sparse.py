"""Compressed rows in both directions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.sources.matrix import from_dense
from rankloom.sources.sparse import from_csr, read_csr, to_csr, unpacked

RNG = np.random.default_rng(5)
DENSE = RNG.poisson(0.6, (23, 9)).astype(float)
DENSE[[0, 7, 8, 22]] = 0  # empty rows at the beginning, together, and at the end
DENSE[11] = 3  # a full one


def arrays(dense):
    rows, genes = np.nonzero(dense)
    return np.r_[0, np.cumsum((dense != 0).sum(1))].tolist(), genes.tolist(), dense[rows, genes].tolist()


def frames(spark, indptr, indices, data, width=9):
    starts = spark.createDataFrame(list(enumerate(indptr)), "row long, start long")
    items = spark.createDataFrame([(i, j, v) for i, (j, v) in enumerate(zip(indices, data))], "position long, gene_idx int, value double").repartition(3, "gene_idx")
    return starts, items, spark.range(width).select(F.col("id").cast("int").alias("gene_idx"), F.concat(F.lit("g"), "id").alias("feature"))


def dense(matrix, shape=DENSE.shape):
    out = np.zeros(shape)
    for r in matrix.entries.collect():
        out[r["cell_id"], r["gene_idx"]] += r["value"] or 0
    return out


@pytest.mark.parametrize("block", [1, 4, 64, 65_536])
def test_every_position_finds_its_row(spark, block):
    found = from_csr(*frames(spark, *arrays(DENSE)), block=block)
    assert (dense(found) == DENSE).all()
    assert sorted(r[0] for r in found.cells.collect()) == list(range(23))


def test_chunks(spark):
    indptr, indices, data = arrays(DENSE)
    starts, _, genes = frames(spark, indptr, indices, data)
    runs = [(i, indices[i:i + 7], data[i:i + 7]) for i in range(0, len(data), 7)]
    kinds = "first long, indices array<int>, data array<double>"
    assert (dense(from_csr(starts, unpacked(spark.createDataFrame(runs[::-1], kinds)), genes, block=5)) == DENSE).all()
    with pytest.raises(ValueError, match="as many indices"):
        unpacked(spark.createDataFrame([(0, [1, 2], [1.0])], kinds))


def test_round_trip_keeps_labels(spark, tmp_path):
    matrix = from_dense(spark, DENSE, {"guide": [f"l{i % 4}" for i in range(23)]}, first_cell=100)
    to_csr(matrix, f"file://{tmp_path}/csr", block=5)
    found = read_csr(spark, f"file://{tmp_path}/csr")
    assert (dense(found) == DENSE).all()
    assert {(r["cell_id"], r["guide"]) for r in found.cells.collect()} == {(i, f"l{i % 4}") for i in range(23)}
    assert [r["start"] for r in spark.read.parquet(f"file://{tmp_path}/csr/starts").orderBy("row").collect()] == arrays(DENSE)[0]


def test_repeated_null_and_stored_zero_values(spark):
    starts, _, genes = frames(spark, [0, 3, 4], [0] * 4, [1.0] * 4)
    items = spark.createDataFrame([(0, 2, 1.5, "x"), (1, 2, 2.0, "y"), (2, 1, None, None), (3, 0, 0.0, None)], "position long, gene_idx int, value double, row string")
    assert (dense(from_csr(starts, items, genes), (2, 9))[0] == [0, 0, 3.5, 0, 0, 0, 0, 0, 0]).all()


def test_no_entries_and_no_rows(spark):
    for indptr in ([0, 0, 0], [0]):
        found = from_csr(*frames(spark, indptr, [], []))
        assert found.entries.isEmpty() and found.cells.count() == len(indptr) - 1


@pytest.mark.parametrize("indptr, positions, genes, match", [
    ([], [], [], "run from 0"), ([1, 2], [0, 1], [0, 0], "begin at 0"), ([0, 2, 1, 3], [0, 1, 2], [0] * 3, "never fall"), ([0, 3], [0, 1], [0] * 2, "positions"),
    ([0, 2], [0, 1, 2], [0] * 3, "positions"), ([0, 3], [0, 1, 1], [0] * 3, "positions"), ([0, 2], [0, 5], [0] * 2, "positions"), ([0, 2], [-1, 0], [0] * 2, "positions"), ([0, 2], [0, None], [0] * 2, "positions"),
    ([0, 2], [0, 1], [0, 9], "genes outside"), ([0, 2], [0, 1], [None, 1], "genes outside")])
def test_broken_arrays(spark, indptr, positions, genes, match):
    starts, _, names = frames(spark, indptr, [], [])
    items = spark.createDataFrame([(p, g, 1.0) for p, g in zip(positions, genes)], "position long, gene_idx int, value double")
    with pytest.raises(ValueError, match=match):
        from_csr(starts, items, names)


def test_broken_rows_and_labels(spark):
    starts, items, genes = frames(spark, [0, 1, 2], [0, 1], [1.0, 1.0])
    for bad in ([(0, 0), (1, 1), (3, 2)], [(0, 0), (1, 1), (1, 1), (2, 2), (4, 2)], [(1, 0), (2, 1), (3, 2)]):
        with pytest.raises(ValueError, match="without gaps"):
            from_csr(spark.createDataFrame(bad, "row long, start long"), items, genes)
    for rows in ([0], [0, 0], [0, 2]):
        with pytest.raises(ValueError, match="name each"):
            from_csr(starts, items, genes, spark.createDataFrame([(r,) for r in rows], "row long"))
