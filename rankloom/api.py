"""The grouped rank test: every target group against a reference population, gene by gene."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.special import log2_ratio
from .operators import normalize, ranks, shift, statistics
from .plans import spec as plan
from .plans.spec import ALL_OTHERS, COLUMNS, REMOVED, Spec, scale_factor, shift_names, tau_names
from .sources.archive import open_archive, resolve
from .sources.groups import from_groups
from .sources.matrix import CellGroup, CountMatrix, from_dense, noncount_signal, reject_missing
from .sources.places import stored
from .sources.reference import POOL, Reference

_NAN = float("nan")


@dataclass(frozen=True)
class Study:
    """What every source becomes: entries and cells with a side (0 target, 1 reference), genes, and the targets."""

    entries: DataFrame
    cells: DataFrame  # cell_id, group, side
    genes: DataFrame  # gene_idx, feature
    rest: bool = False
    targets: Sequence[str] | None = None  # targets that are reported even without cells
    reference: Reference | None = None  # instead of cells of side 1


def _labelled(matrix: CountMatrix, column: str) -> DataFrame:
    return matrix.cells.select("cell_id", F.col(column).cast("string").alias("group"))


def _sided(matrix: CountMatrix, cells: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Entries and cells whose ids name their side too, so that two matrices may count their cells alike."""
    own = F.struct(F.lit(side).alias("of"), F.col("cell_id").cast("string").alias("id"))
    return matrix.entries.select(own.alias("cell_id"), "gene_idx", "value"), cells.select(own.alias("cell_id"), "group", F.lit(side).alias("side"))


def _with_pool(targets: CountMatrix, cells: DataFrame, pool: CountMatrix | Reference, names: Sequence[str] | None = None) -> Study:
    if isinstance(pool, Reference):
        if not pool.fits(targets.genes):
            raise ValueError("the reference pool's genes do not match the targets' genes, in number and order")
        return Study(targets.entries, cells.withColumn("side", F.lit(0)), targets.genes, targets=names, reference=pool)
    if not pool.same_genes(targets):
        raise ValueError("the reference pool's genes do not match the targets' genes, in number and order")
    if pool.cells.isEmpty():
        raise ValueError("the reference pool has no cells")
    e0, c0 = _sided(targets, cells, 0)
    e1, c1 = _sided(pool, pool.cells.select("cell_id", F.lit(POOL).alias("group")), 1)
    return Study(e0.unionByName(e1), c0.unionByName(c1), targets.genes, targets=names)


def _within(matrix: CountMatrix, column: str, reference: str | list[str]) -> Study:
    labels = [reference] if isinstance(reference, str) else reference
    cells = _labelled(matrix, column)
    if reference == ALL_OTHERS:
        return Study(matrix.entries, cells.withColumn("side", F.lit(0)), matrix.genes, rest=True)
    side = F.when(F.col("group").isin(labels), 1).otherwise(0)
    sided = cells.withColumn("side", side).withColumn("group", F.when(F.col("side") == 1, F.lit(POOL)).otherwise(F.col("group")))
    if sided.where("side = 1").isEmpty():
        raise ValueError(f"reference {reference!r} is not a label of {column!r}")
    return Study(matrix.entries, sided, matrix.genes)


@dataclass(frozen=True)
class Sums:
    """What a run needs of its cells.  The sums of cells that are apart add up to those of all of them (``added``)."""

    groups: DataFrame  # side, group, n_cells, library, library1: a row for each group
    seen: DataFrame  # side, group, gene_idx, v, n, raw[, cpm]: how often each value stands


_KEYS = ["side", "group", "gene_idx"]
#: Genes whose numbers are sent to all tasks; more of them are joined.
BROADCAST_GENES = 1_000_000


def _small(genes: DataFrame, many: int) -> DataFrame:
    return F.broadcast(genes) if many <= BROADCAST_GENES else genes


def _masked(spark: SparkSession, keep_genes: Sequence[bool] | None, many: int) -> DataFrame | None:
    """The numbers of the genes that a mask keeps."""
    if keep_genes is None:
        return None
    mask = np.asarray(keep_genes)
    if mask.dtype != np.bool_ or mask.shape != (many,):
        raise ValueError(f"keep_genes must be {many} booleans")
    return spark.createDataFrame(pd.DataFrame({"gene_idx": np.flatnonzero(mask).astype(np.int32)}), "gene_idx int")


def summed(study: Study, spec: Spec, keep_genes: Sequence[bool] | None = None, counts_expected: bool = False) -> tuple[Sums, float | None]:
    """A study's sums, and the target sum as a number.

    The source is read once: its entries go to the shared folder beside their cells' groups and
    totals, then the histogram of values, of the genes that the mask keeps.
    """
    reference, many = study.reference, study.genes.count()
    mask = _masked(study.cells.sparkSession, keep_genes, many)
    if reference is not None and reference.total != spec.total:
        raise ValueError(f"the reference was prepared for a target sum of {reference.total}, not {spec.total}")
    rows = stored(normalize.gathered(study.entries, study.cells))
    if counts_expected and (noncount_signal(rows.where("value is not null")) or (reference is not None and not reference.manifest["counts"])):
        warnings.warn("values are negative or fractional: scaling by totals expects raw counts", UserWarning, stacklevel=4)
    total = normalize.resolve_total(spec.total, rows.where("first"))
    own = F.col("first")
    groups = rows.groupBy("side", "group").agg(F.count(F.when(own, 1)).alias("n_cells"), F.sum(F.when(own, F.col("library"))).alias("library"), F.sum(F.when(own, F.when(F.col("library") == 0, 1.0).otherwise(F.col("library")))).alias("library1"))
    entries = rows.where("gene_idx is not null")
    if mask is not None:
        entries = entries.join(_small(mask, many), "gene_idx", "left_semi")
    return Sums(groups, stored(normalize.histogram(entries, _KEYS, total, "cpm_cell" in spec.filters))), total


def added(parts: Sums) -> Sums:
    """Sums of several sets of cells in one."""
    groups = parts.groups.groupBy("side", "group").agg(*(F.sum(c).alias(c) for c in ("n_cells", "library", "library1")))
    return Sums(groups, parts.seen.groupBy(*_KEYS, "v").agg(*(F.sum(c).alias(c) for c in parts.seen.columns if c not in (*_KEYS, "v", "batch"))))


def test(study: Study, spec: Spec, keep_genes: Sequence[bool] | None = None, ordered: bool = False, counts_expected: bool = False) -> DataFrame:
    """The whole computation over a study; one row for each target and gene that the filters keep."""
    sums, total = summed(study, spec, keep_genes, counts_expected)
    return ranked(study, sums, spec, total, keep_genes, ordered)


def ranked(study: Study, found: Sums, spec: Spec, total: float | None, keep_genes: Sequence[bool] | None = None, ordered: bool = False) -> DataFrame:
    """The computation from a study's sums; its entries and cells are not read.

    Masks act before anything is made for a gene.  Filters act before ranks are taken: where they
    leave less than half of all pairs of group and gene, only these pairs' values are ranked, and
    only their genes' values of the reference.
    """
    many, reference = study.genes.count(), study.reference
    spark = study.genes.sparkSession
    mask = _masked(spark, keep_genes, many)
    # A table with one row for each group; a row without cells for targets that have none.
    groups, seen = found.groups, found.seen
    if study.targets is not None:
        named = spark.createDataFrame([(str(t),) for t in study.targets], "group string").withColumn("side", F.lit(0))
        absent = named.join(groups.where("side = 0").select("group"), "group", "left_anti").select("side", "group", F.lit(0).cast("long").alias("n_cells"), F.lit(0.0).alias("library"), F.lit(0.0).alias("library1"))
        groups = groups.unionByName(absent)
    if reference is not None:
        groups = groups.unionByName(reference.groups())
    groups = stored(groups)
    population, n_targets = groups.agg(F.coalesce(F.sum("n_cells"), F.lit(0)), F.count(F.when(F.col("side") == 0, 1))).first()
    wide = population > ranks.CUBE_LIMIT

    keys, geometric, cpm = _KEYS, spec.mean_calc == "geometric", "cpm_cell" in spec.filters
    moments = normalize.moments(seen, keys, geometric, cpm)
    if reference is not None:
        moments = moments.unionByName(reference.moments.select(F.lit(1).alias("side"), F.lit(POOL).alias("group"), *moments.columns[2:]))
    grid = groups.withColumn("gene_idx", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))) if many else groups.withColumn("gene_idx", F.lit(0)).limit(0)
    if mask is not None:
        grid = grid.join(_small(mask, many), "gene_idx", "left_semi")
    skeleton = stored(grid.join(moments, keys, "left").fillna(0, [c for c in moments.columns if c not in keys]))
    hist = ranks.with_zeros(seen, skeleton if reference is None else skeleton.where("side = 0"))

    n = F.when(F.col("n_cells") > 0, F.col("n_cells"))
    mean = F.coalesce(F.col("sum_x") / n, F.lit(_NAN))
    shown = F.coalesce(F.expm1(F.col("sum_log") / n), F.lit(_NAN)) if spec.mean_calc == "geometric" else mean
    quantities = {"value": F.coalesce(F.col("sum_raw") / n, F.lit(_NAN)), "sum": F.col("sum_raw"), "cpm_bulk": F.col("sum_raw") / F.when(F.col("library1") > 0, F.col("library1")).otherwise(1.0) * 1e6}
    if "cpm_cell" in spec.filters:
        quantities["cpm_cell"] = F.coalesce(F.col("sum_cpm") / n, F.lit(_NAN)) if total is None else mean * (1e6 / total)
    asked = list(spec.filters)
    if study.rest:
        whole = Window.partitionBy("gene_idx")  # one row for each group
        others = skeleton
        for c in ("n_cells", "sum_x", "sum_raw", "library", "library1", *(["sum_cpm"] if "cpm_cell" in asked else [])):
            others = others.withColumn(f"o_{c}", F.sum(c).over(whole) - F.col(c))
        least = F.greatest(F.col("o_n_cells"), F.lit(1))
        rest = {"value": F.col("o_sum_raw") / least, "sum": F.col("o_sum_raw"), "cpm_bulk": F.col("o_sum_raw") / F.when(F.col("o_library1") > 0, F.col("o_library1")).otherwise(1.0) * 1e6}
        if "cpm_cell" in asked:
            rest["cpm_cell"] = F.col("o_sum_cpm") / least if total is None else F.col("o_sum_x") / least * (1e6 / total)
        base = others.select("group", "gene_idx", "n_cells", shown.alias("target_mean"), (F.col("o_sum_x") / least).alias("ref_mean"), F.col("o_n_cells").alias("ref_ncells"), *(quantities[k].alias(f"t_{k}") for k in asked), *(rest[k].alias(f"r_{k}") for k in asked))
    else:
        of = skeleton.select("side", "group", "gene_idx", "n_cells", shown.alias("mean"), *(quantities[k].alias(k) for k in asked))
        pool = of.where("side = 1").select("gene_idx", F.col("mean").alias("ref_mean"), F.col("n_cells").alias("ref_ncells"), *(F.col(k).alias(f"r_{k}") for k in asked))
        base = of.where("side = 0").select("group", "gene_idx", "n_cells", F.col("mean").alias("target_mean"), *(F.col(k).alias(f"t_{k}") for k in asked)).join(pool, "gene_idx")
    genes, kept = mask, base
    keep = [statistics.passes(F.col(f"t_{k}"), F.col(f"r_{k}"), t) for k, t in spec.filters.items()]
    if keep:
        kept = stored(base.where(statistics.all_of(keep)))
        if kept.count() * 2 < skeleton.where("side = 0").count():
            genes = stored(kept.select("gene_idx").distinct())
            near = hist.join(_small(genes, many), "gene_idx", "left_semi")
            if not study.rest:  # all groups of a gene are each other's reference
                near = near.where("side = 0").join(kept.select("group", "gene_idx"), ["group", "gene_idx"], "left_semi").select(*hist.columns).unionByName(near.where("side = 1").select(*hist.columns))
            hist = near
    genes = None if genes is None else _small(genes, many)
    if study.rest:
        sums = ranks.against_rest(hist, wide).withColumn("tie_0", F.col("tie"))
    else:
        factors = [1.0, *(scale_factor(*t) for t in spec.taus)]
        sums = ranks.against_reference(hist, factors, wide, reference, genes)
        for k in range(len(factors)):
            sums = sums.withColumn(f"tie_{k}", F.col("ref_tie") + F.col(f"cross_{k}"))
    rows = kept.join(sums, ["group", "gene_idx"], "left").withColumnRenamed("n_cells", "target_ncells")

    m, r = F.col("target_ncells"), F.col("ref_ncells")
    u = F.coalesce(F.col("u2_0").cast("double") / 2, F.lit(0.0))
    if study.rest:
        u = u - m.cast("double") * (m + 1) / 2
    both = (m > 0) & (r > 0) if not study.rest else F.lit(True)
    zero = F.lit(0)
    rows = statistics.with_p(rows.withColumn("_u", u), "p_value", F.col("_u"), F.coalesce("tie_0", zero), m, r, valid=both)
    rows = rows.withColumn("Ueffect", statistics.effect(F.col("_u"), m, r))
    rows = rows.withColumn("log2_fold_change", log2_ratio(F.col("target_mean") + spec.epsilon, F.col("ref_mean") + spec.epsilon))
    for k, (tau, way) in enumerate(spec.taus, 1):
        p, e, _ = tau_names(tau, way)
        rows = statistics.with_p(rows.withColumn("_u", F.coalesce(F.col(f"u2_{k}").cast("double") / 2, F.lit(0.0))), p, F.col("_u"), F.coalesce(f"tie_{k}", zero), m, r, way, both)
        rows = rows.withColumn(e, statistics.effect(F.col("_u"), m, r))
    if spec.levels:
        if reference is not None:
            pool = reference.values if genes is None else reference.values.join(genes, "gene_idx", "left_semi")
            hist = hist.unionByName(pool.select(F.lit(1).alias("side"), F.lit(POOL).alias("group"), "gene_idx", "v", F.col("rc").alias("n")))
        found = shift.shifts(hist, spec.levels, spec.se, n_targets).withColumnsRenamed({"group": "_g", "gene_idx": "_j"})
        rows = rows.join(found, (F.col("group") == F.col("_g")) & (F.col("gene_idx") == F.col("_j")), "left")
        for i, name in enumerate(shift_names(spec.levels, spec.se)):
            rows = rows.withColumn(name, F.coalesce(F.col("shift")[i], F.lit(_NAN)))
    rows = rows.join(study.genes.select("gene_idx", "feature"), "gene_idx").withColumnRenamed("group", "target")
    rows = stored(rows.select("gene_idx", *(F.col(f"`{c}`") for c in (*COLUMNS, *spec.extra) if c != "p_adj" and not c.endswith("_padj"))))
    rows = statistics.adjusted(rows, {"p_value": "p_adj", **{p: q for p, _, q in (tau_names(*t) for t in spec.taus)}}, key=["target", "gene_idx"])
    if ordered:  # targets as they were named, else by label; genes as they are numbered
        if study.targets is not None:
            places = spark.createDataFrame([(str(t), i) for i, t in enumerate(study.targets)], "target string, place int")
            rows = rows.join(places, "target").orderBy("place", "gene_idx")
        else:
            rows = rows.orderBy("target", "gene_idx")
    wanted = spec.output_columns or {c: c for c in (*COLUMNS, *spec.extra)}
    return rows.select(*(F.col(f"`{c}`").alias(name) for c, name in wanted.items()))


def empty_result(spark: SparkSession, spec: Spec | None = None) -> DataFrame:
    """A result without rows, with the schema that a run has."""
    spec = spec or Spec()
    kinds = {"target": "string", "feature": "string", "target_ncells": "bigint", "ref_ncells": "bigint"}
    wanted = spec.output_columns or {c: c for c in (*COLUMNS, *spec.extra)}
    return spark.createDataFrame([], ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in (*COLUMNS, *spec.extra))).select(*(F.col(f"`{c}`").alias(name) for c, name in wanted.items()))


def de(
    adata: CountMatrix | None = None,
    *,
    archive: str | None = None,
    shard_archive: str | None = None,
    cell_source: Callable[..., Iterable[CellGroup]] | None = None,
    targets: Sequence[str] | None = None,
    var_names: Sequence[str] | None = None,
    groupby: str | None = None,
    reference: str | CountMatrix | Reference | Any | None = None,
    mean_calc: plan.MeanCalc = "arithmetic",
    epsilon: float = 1e-9,
    min_feature_filter: Any = REMOVED,
    gpu_gene_chunk_size: int | None = None,
    oom_recovery: bool = True,
    densify_input: bool = False,
    cpm_normalize: bool = False,
    normalize_target_sum: float | str | None = None,
    output_columns: dict[str, str] | None = None,
    filter_gene_min_mean_value: float | None = None,
    filter_gene_min_total_value: float | None = None,
    filter_gene_min_cpm_cell: float | None = None,
    filter_gene_min_cpm_bulk: float | None = None,
    keep_genes: Sequence[bool] | None = None,
    lfc_threshold: float | Iterable[float] | None = None,
    lfc_threshold_alt: str | Iterable[str] = ("up", "down"),
    tau_star: float | Iterable[float] | None = None,
    tau_star_iters: int | None = None,
    tau_star_se: bool = False,
    stream_n_workers: int = 16,
    stream_prefetch: int = 2,
    release_gpu_memory: bool = True,
    ordered: bool = False,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Rank tests of every target group against a reference, as a DataFrame.

    One source of three: ``adata`` (a CountMatrix, with ``groupby`` and a reference label,
    ``ALL_OTHERS``, a pool matrix or a pool prepared by ``rankloom.sources.reference``), ``archive`` (a path), or ``cell_source`` (with ``targets``,
    ``var_names`` and a pool; of arrays it is read in the executors, in slices if it takes a list
    of labels).  Of an archive only ``targets`` are read, if named.  ``gpu_gene_chunk_size``, ``oom_recovery``, ``densify_input``,
    ``stream_n_workers``, ``stream_prefetch`` and ``release_gpu_memory`` are checked and have no
    effect: Spark sizes, spills and retries; nor has ``tau_star_iters``, as shifts are exact.
    Values must not be NaN.  Rows come in no order unless ``ordered``: then by target (as
    ``targets`` names them, else by label) and gene.  What is computed on the way lies below
    ``spark.checkpoint.dir`` until ``rankloom.sources.places.clear(spark)``; the result reads it.
    """
    archive, reference, spec = plan.checked(
        archive=archive, shard_archive=shard_archive, adata=adata, cell_source=cell_source, reference=reference, min_feature_filter=min_feature_filter, mean_calc=mean_calc, epsilon=epsilon, gpu_gene_chunk_size=gpu_gene_chunk_size,
        lfc_threshold=lfc_threshold, lfc_threshold_alt=lfc_threshold_alt, tau_star=tau_star, tau_star_iters=tau_star_iters, tau_star_se=tau_star_se, cpm_normalize=cpm_normalize, normalize_target_sum=normalize_target_sum, output_columns=output_columns,
        filters={"value": filter_gene_min_mean_value, "sum": filter_gene_min_total_value, "cpm_cell": filter_gene_min_cpm_cell, "cpm_bulk": filter_gene_min_cpm_bulk})
    spark = spark or SparkSession.getActiveSession()
    if cell_source is not None:
        study = _from_source(spark, cell_source, targets, var_names, groupby, reference, spec)
    elif archive is not None:
        study = _from_archive(spark, archive, groupby, reference, targets, stream_n_workers, stream_prefetch, densify_input)
    else:
        study = _from_matrix(adata, groupby, reference, spec, densify_input)
    scaled = spec.total is not None or "cpm_cell" in spec.filters or "cpm_bulk" in spec.filters
    return test(study, spec, keep_genes, ordered, scaled)


def _from_source(spark, cell_source, targets, var_names, groupby, reference, spec) -> Study:
    if not callable(cell_source):
        raise TypeError(f"cell_source must be callable, got {type(cell_source).__name__}")
    if targets is None or var_names is None:
        raise ValueError("cell_source= needs targets= and var_names=")
    targets, features = [str(t) for t in np.atleast_1d(np.asarray(targets, dtype=object))], [str(f) for f in np.atleast_1d(np.asarray(var_names, dtype=object))]
    if np.ndim(targets) != 1 or not targets or not features:
        raise ValueError("targets and var_names must hold names")
    if len(set(targets)) < len(targets):
        raise ValueError("targets repeats a label")
    if groupby is not None:
        raise ValueError("groupby= does not go with cell_source=: the source decides the grouping")
    pool = reference if isinstance(reference, (CountMatrix, Reference)) else None
    if pool is None:
        shape = np.shape(reference)
        if len(shape) != 2 or shape[0] == 0:
            raise ValueError("the reference pool must be a matrix with cells")
        if shape[1] != len(features):
            raise ValueError(f"the reference pool has {shape[1]} genes, var_names {len(features)}")
        pool = from_dense(spark, reference, features=features)
    if spec.total == "median":
        raise NotImplementedError("normalize_target_sum='median' does not go with cell_source=: pass a number")
    matrix = from_groups(spark, cell_source, targets, features)
    return _with_pool(matrix, _labelled(matrix, "group"), pool, targets)


def _from_archive(spark, archive, groupby, reference, targets, workers, prefetch, densify) -> Study:
    for name, value, least in (("stream_n_workers", workers, 1), ("stream_prefetch", prefetch, 0)):
        if not isinstance(value, (int, np.integer)) or isinstance(value, bool):
            raise TypeError(f"{name} must be an int, got {type(value).__name__}")
        if value < least:
            raise ValueError(f"{name} must be at least {least}, got {value}")
    if densify:
        raise ValueError("densify_input does not go with archive=")
    if isinstance(reference, str) and reference == ALL_OTHERS:
        raise NotImplementedError("ALL_OTHERS does not go with archive=")
    opened = open_archive(spark, archive)
    column, pool = resolve(opened, groupby, reference)
    asked = None if targets is None else [str(t) for t in plan.items(targets)]
    matrix = opened.matrix(None if asked is None else list(dict.fromkeys([*asked, *(pool if isinstance(pool, list) else ())])))
    study = _with_pool(matrix, _labelled(matrix, column), pool) if isinstance(pool, (CountMatrix, Reference)) else _within(matrix, column, pool)
    return study if asked is None else replace(study, targets=asked)


def _from_matrix(adata, groupby, reference, spec, densify) -> Study:
    if groupby is None or reference is None:
        raise ValueError("a matrix needs groupby= and reference=")
    if isinstance(reference, (CountMatrix, Reference)):
        if densify:
            raise ValueError("densify_input does not go with a pool as reference=")
    elif not isinstance(reference, str):
        raise ValueError(f"reference= is a label, ALL_OTHERS or a matrix, got {type(reference).__name__}")
    elif reference == ALL_OTHERS and spec.mean_calc == "geometric":
        raise NotImplementedError("ALL_OTHERS does not go with mean_calc='geometric'")
    if groupby not in adata.cells.columns:
        raise ValueError(f"cells have no column {groupby!r}")
    reject_missing(adata.cells, groupby)
    return _with_pool(adata, _labelled(adata, groupby), reference) if isinstance(reference, (CountMatrix, Reference)) else _within(adata, groupby, reference)
