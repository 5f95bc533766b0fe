"""Groups of cells that a callable yields, as a Spark data source: the callable runs in the executors.

A source without parameters is read in one partition from beginning to end.  One that takes a list
of labels is asked for a slice of the targets in each partition.  Either way a task holds one group
at a time, and the driver none.
"""

from __future__ import annotations

import inspect
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .matrix import CellGroup, CountMatrix, checked_rows
from .places import stored

#: A row for each cell (null gene) and each of its values; what a source does wrong is a row too, so that no task is tried again for it.
_SCHEMA = "cell_id long, group string, gene_idx int, value double, error string, message string"
_ARROW = pa.schema([("cell_id", pa.int64()), ("group", pa.string()), ("gene_idx", pa.int32()), ("value", pa.float64()), ("error", pa.string()), ("message", pa.string())])
_ERRORS = {"ValueError": ValueError, "TypeError": TypeError}
_ROWS = 1 << 16  # rows of a batch
_SHIFT = 40  # bits that number the cells of a partition
_SLICES = 4  # partitions for each core, if there are as many targets


def takes_labels(source: Callable) -> bool:
    """Whether the callable wants the labels of a slice."""
    try:
        wanted = inspect.signature(source).parameters.values()
    except (TypeError, ValueError):
        return False
    return any(p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in wanted)


def _values(label: str, matrix: Any, rows: Any, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many cells a group has, and place, gene and value of what is not zero; sparse matrices stay sparse."""
    shape = np.shape(matrix)
    if len(shape) != 2:
        raise ValueError(f"group {label!r} must have two dimensions")
    if shape[1] != width:
        raise ValueError(f"group {label!r} has {shape[1]} genes, var_names {width}")
    if rows is not None:
        rows = checked_rows(rows, shape[0], label)
    if hasattr(matrix, "tocoo"):
        own = (matrix if rows is None else matrix.tocsr()[rows]).tocoo()
        at, gene, value = np.asarray(own.row), np.asarray(own.col), np.asarray(own.data)
        keep = value != 0
        return shape[0] if rows is None else len(rows), at[keep], gene[keep], value[keep]
    array = np.asarray(matrix.toarray() if hasattr(matrix, "toarray") else matrix)
    array = array if rows is None else array[rows]
    at, gene = np.nonzero(array)
    return len(array), at, gene, array[at, gene]


def _item(item: Any) -> CellGroup:
    if not isinstance(item, tuple):
        raise TypeError(f"cell_source yields CellGroup, got {type(item).__name__}")
    found = CellGroup(*item)
    return found._replace(label=str(found.label))


class _Once:
    """Every target exactly once, and nothing else."""

    def __init__(self, targets: Iterable[str]):
        self.open, self.targets = dict.fromkeys(targets), frozenset(targets)

    def take(self, label: str) -> None:
        if label not in self.targets:
            raise ValueError(f"cell_source yielded {label!r}, which is not among the targets")
        if label not in self.open:
            raise ValueError(f"cell_source yielded {label!r} twice")
        del self.open[label]

    def end(self) -> None:
        if self.open:
            raise ValueError(f"cell_source did not yield {list(self.open)[:5]}")


class _Slice(InputPartition):
    def __init__(self, number: int, labels: list[str]):
        super().__init__(number)
        self.number, self.labels = number, labels


def _batches(source: Callable, labels: Sequence[str], width: int, first: int, ask: bool) -> Iterator[pa.RecordBatch]:
    try:
        once = _Once(labels)
        for item in source(list(labels)) if ask else source():
            label, matrix, rows = _item(item)
            once.take(label)
            if isinstance(matrix, CountMatrix):
                raise TypeError("a source of arrays cannot yield a CountMatrix")
            many, at, gene, value = _values(label, matrix, rows, width)
            cell = np.r_[np.arange(many), at] + first
            genes = pa.concat_arrays([pa.nulls(many, pa.int32()), pa.array(gene.astype(np.int32))])
            values = pa.concat_arrays([pa.nulls(many, pa.float64()), pa.array(value.astype(np.float64))])
            for a in range(0, len(cell), _ROWS):
                part = cell[a:a + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([label] * len(part), pa.string()), genes[a:a + _ROWS], values[a:a + _ROWS], pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.string())], schema=_ARROW)
            first += many
        once.end()
    except (ValueError, TypeError) as error:
        kind = "TypeError" if isinstance(error, TypeError) else "ValueError"
        yield pa.RecordBatch.from_pylist([{"error": kind, "message": str(error)}], schema=_ARROW)


def _source_class(name: str, source: bytes, slices: list[list[str]], width: int, ask: bool) -> type[DataSource]:
    """A data source of its own for each callable, which goes to the executors with it."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Slice(i, labels) for i, labels in enumerate(slices)]

        def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
            yield from _batches(pickle.loads(source), partition.labels, width, partition.number << _SHIFT, ask)

    class Groups(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return _SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Groups


def from_groups(spark: SparkSession, source: Callable[..., Iterable[CellGroup]], targets: Sequence[str], features: Sequence[str], slices: int | None = None) -> CountMatrix:
    """A matrix with label column ``group`` from a source that yields every target exactly once, in any order.

    Items hold arrays (dense, or sparse with ``tocoo`` or ``toarray``) or, all of them, matrices of
    the cluster.  The source is begun in the driver to see which, and read whole in the executors
    for arrays; it must be able to travel there.  A target that is missing, strange or repeated, a
    group of another width and rows that do not select are ValueErrors or TypeErrors.
    """
    ask = takes_labels(source)
    head = next(iter(source(list(targets[:1])) if ask else source()), None)
    genes = spark.createDataFrame([(j, str(f)) for j, f in enumerate(features)], "gene_idx int, feature string")
    if isinstance(head, tuple) and len(head) > 1 and isinstance(head[1], CountMatrix):
        return CountMatrix(*_matrices(source(list(targets)) if ask else source(), targets, len(features)), genes)
    many = (slices or spark.sparkContext.defaultParallelism * _SLICES) if ask else 1
    name = f"rankloom_groups_{uuid.uuid4().hex}"
    spark.dataSource.register(_source_class(name, cloudpickle.dumps(source), [part for i in range(many) if (part := list(targets[i::many]))], len(features), ask))
    rows = stored(spark.read.format(name).load())
    wrong = rows.where("error is not null").select("error", "message").orderBy("message").first()
    if wrong is not None:
        raise _ERRORS[wrong["error"]](wrong["message"])
    return CountMatrix(rows.where("gene_idx is not null").select("cell_id", "gene_idx", "value"), rows.where("gene_idx is null").select("cell_id", "group"), genes)


def _matrices(items: Iterable[CellGroup], targets: Sequence[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Entries and cells of groups that are matrices of the cluster; their widths are counted in one job."""
    once, entries, cells, widths = _Once(targets), [], [], []
    for label, matrix, rows in map(_item, items):
        once.take(label)
        if not isinstance(matrix, CountMatrix):
            raise TypeError("a source of CountMatrix cannot yield arrays")
        if rows is not None:
            raise ValueError("rows= goes with arrays; filter a CountMatrix instead")
        cell = F.concat(F.lit(f"{label}/"), F.col("cell_id").cast("string")).alias("cell_id")
        entries.append(matrix.entries.select(cell, "gene_idx", "value"))
        cells.append(matrix.cells.select(cell, F.lit(label).alias("group")))
        widths.append(matrix.genes.agg(F.count("*").alias("n")).select(F.lit(label).alias("group"), "n"))
    once.end()
    for label, n in reduce(DataFrame.unionByName, widths).where(F.col("n") != width).collect():
        raise ValueError(f"group {label!r} has {n} genes, var_names {width}")
    return reduce(DataFrame.unionByName, entries), reduce(DataFrame.unionByName, cells)
