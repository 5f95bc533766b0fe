"""Matrices kept as Parquet with a manifest and an index: the out-of-core source.

``layout="shard"`` keeps each group's entries in files of their own; ``layout="cell"`` sorts them
by group, reference groups first, and a file may hold several groups.  The index says which files
hold a group, with how many rows and bytes, and how many cells it has.  All checks of the rows are
made when an archive is written; opening it compares files with the index and footers with the
manifest and reads no entry, and of some groups it touches their files alone.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import CountMatrix, reject_missing
from .places import stored
from .reference import Reference

LAYOUTS = ("shard", "cell")
#: Cells of a group that go to one file, about.
CELLS_PER_FILE = 100_000
_ENTRIES = "cell_id {}, gene_idx {}, value double, _group string"
_INDEX = "group string, file string, rows long, bytes long"


def label_text(label: Any) -> str:
    return label.decode() if isinstance(label, bytes) else str(label)


@dataclass(frozen=True)
class Archive:
    """An opened archive: manifest and tables; nothing is read before it is asked for."""

    spark: SparkSession
    path: str
    manifest: dict

    @property
    def group_by(self) -> str | None:
        return self.manifest["group_by"]

    @property
    def index(self) -> DataFrame:
        """``(group, file, rows, bytes)``: the files of each group, with its rows in them and their sizes."""
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index")

    @property
    def groups(self) -> DataFrame:
        """``(group, n_cells, n_entries, is_reference)``."""
        return self.spark.read.parquet(f"{self.path}/groups")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def genes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/genes")

    def largest(self) -> int:
        """How many cells the largest group has."""
        return self.groups.agg(F.coalesce(F.max("n_cells"), F.lit(0))).first()[0]

    def _entries(self, files: Sequence[str] | None) -> DataFrame:
        base = f"{self.path}/entries"
        reader = self.spark.read.schema(self.manifest["schema"]).option("basePath", base)
        return reader.parquet(base) if files is None else reader.parquet(*(f"{base}/{f}" for f in files))

    def matrix(self, groups: Sequence[str] | None = None) -> CountMatrix:
        """All of it, or the cells and entries of some groups, from their files.

        A file that is missing, strange or of another size, tables whose rows are not as many as was
        written, and groups without cells are ValueErrors.
        """
        wanted, cells, index = None, self.cells, self.index
        if groups is not None:
            known = {r[0] for r in self.groups.where(F.col("group").isin(*groups)).select("group").collect()}  # of those that the caller names
            if set(groups) - known:
                raise ValueError(f"{self.path}: no cells of {sorted(set(groups) - known)}")
            index = index.where(F.col("group").isin(*groups))
            cells = cells.where(F.col(self.group_by).cast("string").isin(*groups))
            wanted = sorted(r[0] for r in index.select("file").distinct().collect())
        self._check_files(wanted)
        entries = self._entries(wanted) if wanted is None or wanted else self.spark.createDataFrame([], self.manifest["schema"])
        if wanted is None:
            sizes = {"entries": entries, "cells": cells, "genes": self.genes}
            for name, want in self.manifest["rows"].items():
                have = sizes[name].count()  # from the files' footers
                if have != want:
                    raise ValueError(f"{self.path}: {name} has {have} rows, its manifest says {want}")
        else:
            have, want = (self._entries(wanted).count() if wanted else 0), self.index.where(F.col("file").isin(*wanted)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            if have != want:
                raise ValueError(f"{self.path}: the files of {sorted(groups)} have {have} rows, the index says {want}")
            entries = entries.where(F.col("_group").isin(*groups))
        return CountMatrix(entries.select("cell_id", "gene_idx", "value"), cells, self.genes)

    def _check_files(self, wanted: Sequence[str] | None) -> None:
        want = self.index.select("file", F.col("bytes").alias("want")).distinct()
        paths = [f"{self.path}/entries"] if wanted is None else [f"{self.path}/entries/{f}" for f in wanted]
        if wanted is not None:
            want = want.where(F.col("file").isin(*wanted))
        if not paths:
            return
        try:
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
            have = listed.select(F.substring_index("path", "/entries/", -1).alias("file"), F.col("length").alias("have"))
            wrong = want.join(have, "file", "full").where(~F.col("want").eqNullSafe(F.col("have"))).select("file").first()
        except Exception as error:
            raise ValueError(f"{self.path}: files of its entries are missing") from error
        if wrong is not None:
            raise ValueError(f"{self.path}: {wrong[0]} is not as it was written")


def _relative(path) -> Any:
    """A file's path below the entries; a file's metadata have its special characters encoded."""
    return F.url_decode(F.replace(F.substring_index(path, "/entries/", -1), F.lit("+"), F.lit("%2B")))


def write_archive(matrix: CountMatrix, path: str, group_by: str | None, reference: str | Sequence[str] | None = None, layout: str = "shard", mode: str = "error", cells_per_file: int = CELLS_PER_FILE) -> None:
    """Write a matrix; ``group_by`` is a label column of its cells, ``reference`` the labels of the pool it designates.

    Cells that repeat, missing labels, entries of cells that do not exist and reference labels
    without cells are ValueErrors.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}, got {layout!r}")
    spark = matrix.cells.sparkSession
    labels = [] if reference is None else [label_text(r) for r in ([reference] if isinstance(reference, (str, bytes)) else reference)]
    if group_by is not None:
        reject_missing(matrix.cells, group_by, spelled=True)
    label = F.lit(None).cast("string") if group_by is None else F.col(group_by).cast("string")
    if not matrix.cells.groupBy("cell_id").count().where("count > 1").isEmpty():
        raise ValueError("cells repeat")
    sizes = stored(matrix.cells.groupBy(label.alias("_group")).agg(F.count("*").alias("n_cells")))
    seen = {r[0] for r in sizes.where(F.col("_group").isin(*labels)).select("_group").collect()} if labels else set()
    if set(labels) - seen:
        raise ValueError(f"no cells of {sorted(set(labels) - seen)}")
    # A group has as many files as its cells fill; cells of one file are found by hash.
    of = matrix.cells.select("cell_id", label.alias("_group")).join(sizes.select(F.col("_group").alias("_g"), "n_cells"), F.col("_group").eqNullSafe(F.col("_g")))
    of = of.select("cell_id", "_group", F.pmod(F.xxhash64("cell_id"), F.ceil(F.col("n_cells") / cells_per_file)).alias("_part"))
    entries = matrix.entries.select("cell_id", "gene_idx", F.col("value").cast("double").alias("value")).join(of, "cell_id", "left")
    if layout == "shard":
        entries = entries.repartition("_group", "_part")
    else:
        first = F.when(F.col("_group").isin(labels), 0).otherwise(1) if labels else F.lit(0)
        entries = entries.withColumn("_rank", first).repartitionByRange("_rank", "_group", "cell_id").sortWithinPartitions("_rank", "_group", "cell_id").drop("_rank")
    known = F.col("_part").isNotNull()
    kinds = dict(matrix.entries.dtypes)
    schema = _ENTRIES.format(kinds["cell_id"], kinds["gene_idx"])
    # A strange cell's entries are written too, and found by the index.
    entries = entries.withColumn("_group", F.when(known, F.col("_group") if group_by is not None else F.lit("")).otherwise(F.lit(None))).drop("_part")
    if layout == "shard":  # folders cannot be named by nothing, labels can
        entries.withColumn("_shard", F.coalesce(F.concat(F.lit("of:"), "_group"), F.lit("none"))).write.mode(mode).partitionBy("_shard").parquet(f"{path}/entries")
    else:
        entries.write.mode(mode).parquet(f"{path}/entries")
    by_group = F.col("_group").alias("group")
    files = spark.read.schema(schema).parquet(f"{path}/entries").select(by_group, _relative(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_size").alias("bytes"))
    files.groupBy("group", "file", "bytes").agg(F.count("*").alias("rows")).select("group", "file", "rows", "bytes").coalesce(1).sortWithinPartitions("group", "file").write.mode(mode).parquet(f"{path}/index")
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    if not index.where("group is null").isEmpty():
        raise ValueError(f"{path}: entries of cells that do not exist")
    held = index.groupBy("group").agg(F.sum("rows").alias("n_entries"))
    sizes = sizes.withColumn("group", F.coalesce("_group", F.lit(""))).join(held, "group", "left")
    sizes.select("group", "n_cells", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.col("group").isin(labels).alias("is_reference") if labels else F.lit(False).alias("is_reference")).coalesce(1).write.mode(mode).parquet(f"{path}/groups")
    cells = matrix.cells if group_by is None else matrix.cells.repartitionByRange(F.col(group_by), F.col("cell_id")).sortWithinPartitions(group_by)
    cells.write.mode(mode).parquet(f"{path}/cells")
    matrix.genes.write.mode(mode).parquet(f"{path}/genes")
    written = {name: spark.read.parquet(f"{path}/{name}").count() for name in ("entries", "cells", "genes")}
    manifest = {"layout": layout, "group_by": group_by, "reference": labels, "rows": written, "schema": schema}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")


def open_archive(spark: SparkSession, path: str) -> Archive:
    """The archive at ``path``; what kind it is shows by opening it, not by its name."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        found = Archive(spark, path, {k: manifest[k] for k in ("layout", "group_by", "reference", "rows", "schema")})
        for table in (found.index, found.groups, found.cells, found.genes):
            table.schema
    except Exception as error:
        raise ValueError(f"{path} is not an archive: its manifest or a table cannot be read") from error
    return found


def group_table(matrix: CountMatrix, column: str) -> DataFrame:
    """Targets with their numbers of cells."""
    return matrix.cells.groupBy(F.col(column).cast("string").alias("group")).agg(F.count("*").alias("n_cells"))


def resolve(archive: Archive, groupby: str | None, reference: Any) -> tuple[str, list[str] | CountMatrix | Reference]:
    """The grouping column, and the archive's own reference labels or the external pool."""
    column, labels = archive.group_by, archive.manifest["reference"]
    if column is None:
        raise ValueError("the archive was written without group_by: write it again with one")
    if groupby is not None and groupby != column:
        raise ValueError(f"groupby={groupby!r} contradicts the archive's group_by={column!r}")
    if isinstance(reference, (CountMatrix, Reference)):
        if labels:
            warnings.warn("the archive's own reference pool is passed over for the external one", UserWarning, stacklevel=3)
        return column, reference
    if not labels:
        raise ValueError("the archive has no reference: pass a pool as reference=, or write it with reference labels")
    if reference is not None:  # it names the archive's pool and never takes a part of it
        asked = [label_text(r) for r in ([reference] if isinstance(reference, (str, bytes)) else reference)]
        strange = [a for a in asked if a not in labels]
        if strange or not asked:
            raise ValueError(f"reference {strange or asked} is not among the archive's reference labels {labels}")
    return column, labels
