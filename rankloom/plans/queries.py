"""The registered queries: each operator on matrices made from the driver's tables, with SQL that computes the same by brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api
from ..functions.special import erfc_sql, upper_quantile, with_erfc
from ..operators import compare, normalize, ranks, statistics
from ..sources.archive import group_table, open_archive, write_archive
from ..sources.matrix import CellGroup, CountMatrix, collapse_reference, from_table, from_vectors, noncount_signal
from ..sources.places import shared_path, stored
from ..sources.reference import open_reference, prepare
from ..sources.sparse import from_csr, read_csr, to_csr, unpacked
from .spec import ALL_OTHERS, COLUMNS, SE_LEVEL

REFERENCE = "BUILDING"
GRID = (0.0, 0.25)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str, gene: str = "p_brand") -> CountMatrix:
    """Customers by brand (or part): quantities bought; label ``c_mktsegment``."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if gene == "p_brand":
        bought = bought.join(_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    summed = bought.groupBy("o_custkey", gene).agg(F.sum("l_quantity").cast("double").alias("value"))
    cells = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), "c_mktsegment")
    return from_table(summed, "o_custkey", gene, "value", cells)


def vectors(spark: SparkSession, sf_dir: str, width: int = 64) -> CountMatrix:
    table = _table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    return from_vectors(table, "vec_id", "embedding", width, ["label"])


def _even(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many digits, zero without a sign: engines differ in the last place."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _pick(df: DataFrame, *columns: str) -> DataFrame:
    return _even(df.select(*(F.col(f"`{c}`") for c in columns)))


def _de(spark: SparkSession, sf_dir: str, matrix: CountMatrix | None = None, **options) -> DataFrame:
    return _even(api.de(matrix or purchases(spark, sf_dir), groupby="c_mktsegment", **({"reference": REFERENCE} | options)))


def _staged(spark: SparkSession, sf_dir: str, total: float | str) -> DataFrame:
    m = purchases(spark, sf_dir)
    cells = normalize.library_sizes(m.entries, m.cells)
    rows = m.entries.join(cells, "cell_id").withColumn("x", normalize.staged(F.col("value"), normalize.resolve_total(total, cells)).cast("double"))
    return _even(rows.join(m.genes, "gene_idx").select("cell_id", "feature", F.col("x").alias("value")), 4)


def _histogram(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, CountMatrix]:
    m = purchases(spark, sf_dir)
    cells = m.cells.select("cell_id", F.col("c_mktsegment").alias("group"), F.when(F.col("c_mktsegment") == REFERENCE, 1).otherwise(0).alias("side"))
    staged = m.entries.join(cells, "cell_id").withColumn("x", F.col("value").cast("float"))
    grid = cells.groupBy("side", "group").agg(F.count("*").alias("n_cells")).withColumn("gene_idx", F.explode(F.sequence(F.lit(0), F.lit(m.gene_count() - 1))))
    skeleton = grid.join(staged.where("x <> 0").groupBy("side", "group", "gene_idx").agg(F.count("*").alias("nnz")), ["side", "group", "gene_idx"], "left").fillna(0, ["nnz"])
    seen = staged.groupBy("side", "group", "gene_idx", F.col("x").cast("double").alias("v")).agg(F.count("*").alias("n"))
    return ranks.with_zeros(seen, skeleton), m


def ref_tie_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist, m = _histogram(spark, sf_dir)
    ties = hist.where("side = 1").groupBy("gene_idx", "v").agg(F.sum("n").alias("n")).groupBy("gene_idx").agg(F.sum(ranks.cubed(F.col("n"), False)).alias("tie"))
    return ties.join(m.genes, "gene_idx").select("feature", "tie")


def pooled_tie_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist, m = _histogram(spark, sf_dir)
    sums = ranks.against_reference(hist, [1.0], False)
    return sums.join(m.genes, "gene_idx").select(F.col("group").alias("target"), "feature", (F.col("ref_tie") + F.col("cross_0")).alias("tie"))


def u_stat_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist, m = _histogram(spark, sf_dir)
    return ranks.against_reference(hist, [1.0], False).join(m.genes, "gene_idx").select(F.col("group").alias("target"), "feature", (F.col("u2_0") / F.lit(2.0)).alias("u"))


def u_stat_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist, m = _histogram(spark, sf_dir)
    sizes = m.cells.groupBy(F.col("c_mktsegment").alias("group")).agg(F.count("*").alias("m"))
    u = ranks.against_rest(hist, False).join(sizes, "group").join(m.genes, "gene_idx")
    return u.select(F.col("group").alias("target"), "feature", (F.col("u2_0") / F.lit(2.0) - F.col("m") * (F.col("m") + 1) / F.lit(2.0)).alias("u"))


def mwu_external_ref(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    m = purchases(spark, sf_dir)
    return _even(api.de(_part(m, F.col("c_mktsegment") != REFERENCE), groupby="c_mktsegment", reference=_part(m, F.col("c_mktsegment") == REFERENCE), **options))


def mwu_prepared_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in two runs against a pool that was read once, with a grid and shifts."""
    m = purchases(spark, sf_dir)
    path, label = shared_path(spark, "reference"), F.col("c_mktsegment")
    pool = prepare(_part(m, label == REFERENCE), path)
    halves = (_part(m, (label != REFERENCE) & (label < "F")), _part(m, (label != REFERENCE) & (label >= "F")))
    first, second = (api.de(half, groupby="c_mktsegment", reference=open_reference(spark, pool.path), lfc_threshold=GRID) for half in halves)
    return _even(first.unionByName(second))


def _part(m: CountMatrix, condition) -> CountMatrix:
    cells = m.cells.where(condition)
    return CountMatrix(m.entries.join(cells.select("cell_id"), "cell_id", "left_semi"), cells, m.genes)


def byo_cell_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = purchases(spark, sf_dir)
    targets = [r[0] for r in m.cells.select("c_mktsegment").where(F.col("c_mktsegment") != REFERENCE).distinct().orderBy("c_mktsegment").collect()]
    features = [r[0] for r in m.genes.orderBy("gene_idx").select("feature").collect()]

    def source():
        return (CellGroup(t, _part(m, F.col("c_mktsegment") == t)) for t in targets)

    return _even(api.de(cell_source=source, targets=targets, var_names=features, reference=_part(m, F.col("c_mktsegment") == REFERENCE), spark=spark))


def byo_array_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as dense arrays that executors read, a slice of the targets each, from files with an array for each cell."""
    m = purchases(spark, sf_dir)
    path, many = shared_path(spark, "arrays"), m.gene_count()
    filled = m.entries.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_idx", "value"))).alias("at"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda j: F.coalesce(F.col("at")[j], F.lit(0.0)))
    m.cells.join(filled, "cell_id", "left").select("c_mktsegment", dense.alias("x")).write.partitionBy("c_mktsegment").parquet(path)
    targets = [r[0] for r in m.cells.select("c_mktsegment").where(F.col("c_mktsegment") != REFERENCE).distinct().orderBy("c_mktsegment").collect()]
    features = [r[0] for r in m.genes.orderBy("gene_idx").select("feature").collect()]

    def source(labels):
        import numpy as np
        import pyarrow.dataset

        for label in labels:
            rows = pyarrow.dataset.dataset(f"{path}/c_mktsegment={label}", format="parquet").to_table(columns=["x"]).column("x").combine_chunks()
            yield CellGroup(label, np.asarray(rows.flatten()).reshape(len(rows), many))

    return _even(api.de(cell_source=source, targets=targets, var_names=features, reference=_part(m, F.col("c_mktsegment") == REFERENCE), spark=spark))


def _archived(layout: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, f"archive-{layout}")
        write_archive(purchases(spark, sf_dir), path, "c_mktsegment", REFERENCE, layout)
        return _even(api.de(archive=path, spark=spark))

    return run


def archive_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of an archive in their asked order, from their own and the reference's files alone."""
    path = shared_path(spark, "archive-targets")
    write_archive(purchases(spark, sf_dir), path, "c_mktsegment", REFERENCE, "cell")
    return _even(api.de(archive=path, targets=["MACHINERY", "FURNITURE"], ordered=True, spark=spark))


def archive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an archive's index knows of its groups, over customers by part."""
    path = shared_path(spark, "archive-groups")
    write_archive(purchases(spark, sf_dir, "l_partkey"), path, "c_mktsegment", REFERENCE)
    return open_archive(spark, path).groups.select("group", "n_cells", "n_entries", "is_reference")


def csr_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole test over a matrix that was written as compressed rows and decoded from them."""
    path = shared_path(spark, "csr")
    to_csr(purchases(spark, sf_dir), path)
    return _de(spark, sf_dir, matrix=read_csr(spark, path))


def csr_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed rows of customers by part, their arrays in runs of 1,000 positions, decoded to entries again."""
    path = shared_path(spark, "csr")
    to_csr(purchases(spark, sf_dir, "l_partkey"), path)
    starts, nonzeros, cells, genes = (spark.read.parquet(f"{path}/{name}") for name in ("starts", "nonzeros", "cells", "genes"))
    item = F.array_sort(F.collect_list(F.struct("position", "gene_idx", "value")))
    runs = nonzeros.groupBy(F.expr("position div 1000 * 1000").alias("first")).agg(item.alias("items")).select("first", F.col("items.gene_idx").alias("indices"), F.col("items.value").alias("data"))
    m = from_csr(starts, unpacked(runs), genes)
    named = m.entries.join(cells.select(F.col("row").alias("cell_id"), F.col("cell_id").alias("customer")), "cell_id")
    return named.join(m.genes, "gene_idx").select("customer", "feature", "value")


def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.arrivals import arrivals, watch

    m = purchases(spark, sf_dir)
    source, out, place = (shared_path(spark, f"arrivals-{x}") for x in ("in", "out", "checkpoint"))
    rows = arrivals(_part(m, F.col("c_mktsegment") != REFERENCE), "c_mktsegment")
    rows.repartition("group").sortWithinPartitions("group").write.parquet(source)  # whole groups in each file
    pool = _part(m, F.col("c_mktsegment") == REFERENCE)
    watch(spark, source, pool, out, place).awaitTermination()
    return _even(spark.read.parquet(f"{out}/results").drop("batch"))


def stream_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that arrive in parts: every file has cells of many groups, and each batch a third of the files."""
    from ..streaming.arrivals import arrivals, results, watch

    m = purchases(spark, sf_dir)
    source, out, place = (shared_path(spark, f"parts-{x}") for x in ("in", "out", "checkpoint"))
    arrivals(_part(m, F.col("c_mktsegment") != REFERENCE), "c_mktsegment").repartition(6, "cell_id").write.parquet(source)
    watch(spark, source, _part(m, F.col("c_mktsegment") == REFERENCE), out, place, files_per_batch=2).awaitTermination()
    return _even(results(spark, out))


def collapse_reference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = purchases(spark, sf_dir)
    label = collapse_reference(F.col("c_mktsegment"), "MA", REFERENCE)
    merged = CountMatrix(m.entries, m.cells.withColumn("c_mktsegment", label), m.genes)
    return _even(api.de(merged, groupby="c_mktsegment", reference=REFERENCE))


def result_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results on their common keys: how many each has alone, and both correlations of every value column."""
    m = purchases(spark, sf_dir)
    a = stored(_de(spark, sf_dir, matrix=m))
    b = stored(_de(spark, sf_dir, matrix=m, normalize_target_sum=1e4, filter_gene_min_mean_value=20.0))
    return _even(compare.correlations(a, b).crossJoin(F.broadcast(compare.coverage(a, b))), 6)  # one row


def top_genes_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten genes with the largest totals, over a fixed sample of 20 cells of each group."""
    m = purchases(spark, sf_dir)
    order = Window.partitionBy("c_mktsegment").orderBy(F.md5(F.col("cell_id").cast("string")), "cell_id")
    sample = m.cells.withColumn("r", F.row_number().over(order)).where("r <= 20").select("cell_id")
    totals = m.entries.join(sample, "cell_id", "left_semi").groupBy("gene_idx").agg(F.sum("value").alias("total"))
    return _even(totals.join(m.genes, "gene_idx").select("feature", "total").orderBy(F.desc("total"), "feature").limit(10))


def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustment alone, families by order status, a p-value made from each order's price."""
    p = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("target"), F.col("o_orderkey").alias("o_orderkey"), (F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(100_003)) / F.lit(100_003.0)).alias("p"))
    return _even(statistics.adjusted(p, {"p": "p_adj"}))


def special_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("c_acctbal") / F.lit(1500.0)).cast("double")
    return _even(with_erfc(_table(spark, sf_dir, "customer").select("c_custkey", z.alias("z")), F.col("z"), "erfc"), 10)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _de(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mwu_ref": _de,
    "mwu_all_others": lambda s, d: _de(s, d, reference=ALL_OTHERS),
    "mwu_external_ref": mwu_external_ref,
    "mwu_prepared_ref": mwu_prepared_ref,
    "byo_cell_source": byo_cell_source,
    "byo_array_groups": byo_array_groups,
    "archive_shard": _archived("shard"),
    "archive_cell": _archived("cell"),
    "archive_targets": archive_targets,
    "archive_groups": archive_groups,
    "csr_arrays": csr_arrays,
    "csr_chunks": csr_chunks,
    "stream_arrivals": stream_arrivals,
    "stream_parts": stream_parts,
    "library_size": lambda s, d: (lambda m: normalize.library_sizes(m.entries, m.cells).select("cell_id", F.col("library").alias("library_size")))(purchases(s, d)),
    "target_sum_median": lambda s, d: (lambda m: s.range(1).select(F.lit(normalize.exact_median(normalize.library_sizes(m.entries, m.cells).where("library > 0"), "library")).alias("target_sum")))(purchases(s, d)),
    "group_counts": lambda s, d: group_table(purchases(s, d), "c_mktsegment").orderBy(F.desc("n_cells"), "group"),
    "group_means_arith": lambda s, d: _pick(_de(s, d), "target", "feature", "target_mean", "ref_mean"),
    "group_means_geom": lambda s, d: _pick(_de(s, d, mean_calc="geometric"), "target", "feature", "target_mean", "ref_mean"),
    "normalize_cpm": lambda s, d: _staged(s, d, 1e6),
    "normalize_median": lambda s, d: _staged(s, d, "median"),
    "log1p_normalize": lambda s, d: (lambda m: _even(normalize.log1p_normalized(m.entries, m.cells, 1e4).join(m.genes, "gene_idx").select("cell_id", "feature", "value"), 5))(purchases(s, d)),
    "mwu_normalized": lambda s, d: _de(s, d, normalize_target_sum=1e4),
    "mwu_median": lambda s, d: _de(s, d, normalize_target_sum="median"),
    "noncount_check": lambda s, d: s.range(1).select(F.lit(noncount_signal(purchases(s, d).entries)).alias("counts"), F.lit(noncount_signal(vectors(s, d).entries)).alias("vectors")),
    "ref_tie_term": ref_tie_term,
    "pooled_tie_term": pooled_tie_term,
    "u_stat_ref": u_stat_ref,
    "u_stat_rest": u_stat_rest,
    "effect_size": lambda s, d: _pick(_de(s, d), "target", "feature", "Ueffect"),
    "log2fc": lambda s, d: _pick(_de(s, d), "target", "feature", "log2_fold_change"),
    "log2fc_eps0": lambda s, d: _pick(_de(s, d, epsilon=0.0), "target", "feature", "log2_fold_change"),
    "filter_mean": lambda s, d: _de(s, d, filter_gene_min_mean_value=20.0),
    "filter_total": lambda s, d: _de(s, d, filter_gene_min_total_value=6000.0),
    "filter_cpm_cell": lambda s, d: _de(s, d, filter_gene_min_cpm_cell=41_000.0),
    "filter_cpm_bulk": lambda s, d: _de(s, d, filter_gene_min_cpm_bulk=40_500.0),
    "keep_genes": lambda s, d: (lambda m: _even(api.de(m, groupby="c_mktsegment", reference=REFERENCE, keep_genes=[i % 3 == 0 for i in range(m.gene_count())])))(purchases(s, d)),
    "bh_fdr": bh_fdr,
    "special_functions": special_functions,
    "lfc_up_down_grid": lambda s, d: _de(s, d, lfc_threshold=GRID),
    "tau_star": lambda s, d: _pick(_de(s, d, tau_star=(0.05, 0.5)), "target", "feature", "tau*_p0.05", "tau*_p0.5"),
    "tau_star_se": lambda s, d: _pick(_de(s, d, tau_star=0.5, tau_star_se=True), "target", "feature", "tau*_p0.5", "tau*_lo_p0.025", "tau*_hi_p0.025", "tau*_se"),
    "output_columns": lambda s, d: _de(s, d, output_columns={"feature": "gene", "target": "feature", "p_adj": "q"}),
    "empty_schema": lambda s, d: _de(s, d, lfc_threshold=0.5, lfc_threshold_alt="up", filter_gene_min_mean_value=1e12),
    "topk_hits": lambda s, d: _pick(_de(s, d).orderBy("p_adj", "target", "feature").limit(5), "target", "feature", "p_adj"),
    "rank_of_gene": lambda s, d: (lambda r: _pick(r.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("p_value", "feature"))).where(F.col("feature") == "Brand#11"), "target", "feature", "place", "p_value"))(_de(s, d)),
    "collapse_reference": collapse_reference_query,
    "result_compare": result_compare,
    "top_genes_sample": top_genes_sample,
    "mwu_sparse": lambda s, d: _de(s, d, matrix=purchases(s, d, "l_partkey")),
    "mwu_vectors": lambda s, d: _even(api.de(vectors(s, d), groupby="label", reference="0"), 8),
}

# ---------------------------------------------------------------- the same in SQL, pair by pair

_M1 = """
e AS (SELECT o_custkey AS cell, p_brand AS gene, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
c AS (SELECT c_custkey AS cell, c_mktsegment AS grp FROM customer),
g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS idx FROM (SELECT DISTINCT gene FROM e)),
"""
_M3 = """
e AS (SELECT o_custkey AS cell, CAST(l_partkey AS VARCHAR) AS gene, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT c_custkey AS cell, c_mktsegment AS grp FROM customer),
g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS idx FROM (SELECT DISTINCT gene FROM e)),
"""
_M2 = """
e AS (SELECT vec_id AS cell, CAST(i - 1 AS VARCHAR) AS gene, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
c AS (SELECT vec_id AS cell, CAST(label AS VARCHAR) AS grp FROM embeddings),
g AS (SELECT gene, CAST(gene AS BIGINT) AS idx FROM (SELECT DISTINCT gene FROM e)),
"""
_LIB = "lib AS (SELECT c.cell, c.grp, coalesce(sum(v), 0) AS l FROM c LEFT JOIN e ON e.cell = c.cell GROUP BY ALL),"


def _values(total: str | None) -> str:
    scale = "" if total is None else f" * CAST({total} / CASE WHEN l = 0 THEN 1 ELSE l END AS FLOAT)"
    return f"x AS (SELECT lib.cell, grp, l, g.gene, idx, coalesce(v, 0) AS raw, CAST(CAST(coalesce(v, 0) AS FLOAT){scale} AS DOUBLE) AS x, coalesce(v, 0) * CAST(CAST(1e6 / CASE WHEN l = 0 THEN 1 ELSE l END AS FLOAT) AS DOUBLE) AS cpm FROM lib CROSS JOIN g LEFT JOIN e ON e.cell = lib.cell AND e.gene = g.gene),"


_MEDIAN = "(SELECT median(l) FROM lib WHERE l > 0)"


def _run(base: str = _M1, total: str | None = None, reference: str = REFERENCE, rest: bool = False, taus=(), where: str = "TRUE", epsilon: float = 1e-9, geometric: bool = False, label: str = "grp", digits: int = 9, columns: list[str] | None = None, tail: str = "") -> str:
    """The whole test by joining every target value with every reference value."""
    factors = [(0, 1.0, "")] + [(k, 2.0 ** (-t if d == "up" else t), d) for k, (t, d) in enumerate(taus, 1)]
    mean = "exp(avg(ln(1 + x))) - 1" if geometric else "avg(x)"
    apart = "t.grp <> r.grp" if rest else f"t.grp <> '{reference}' AND r.grp = '{reference}'"
    p = []
    for k, s, d in factors:
        most = {"": "greatest(u, mn - u)", "up": "u", "down": "mn - u"}[d]
        p.append(f"z{k} AS (SELECT target, gene, u, mn, ({most} - mn / 2 - 5e-1) / sqrt(greatest(mn / 12 * ((m + n + 1) - tie / greatest((m + n) * (m + n - 1), 1)), 2.2250738585072014e-308)) / sqrt(2e0) AS z FROM k WHERE k = {k}), p{k} AS (SELECT target, gene, u, mn, {'least(greatest(' if not d else '5e-1 * ('}{erfc_sql('z')}{', 0), 1)' if not d else ')'} AS p FROM z{k})")
    fields = {"target": "b.target", "feature": "b.gene", "target_mean": "tm", "ref_mean": "rm", "target_ncells": "CAST(b.m AS BIGINT)", "ref_ncells": "CAST(b.n AS BIGINT)", "log2_fold_change": f"CASE WHEN tm + {epsilon!r} = 0 AND rm + {epsilon!r} = 0 THEN CAST('NaN' AS DOUBLE) WHEN rm + {epsilon!r} = 0 THEN CAST('inf' AS DOUBLE) WHEN tm + {epsilon!r} = 0 THEN CAST('-inf' AS DOUBLE) ELSE log2((tm + {epsilon!r}) / (rm + {epsilon!r})) END", "p_value": "p0.p", "Ueffect": "2 * p0.u / p0.mn - 1", "p_adj": "NULL"}
    select = ", ".join(f'{v} AS "{n}"' for n, v in fields.items() if n != "p_adj")
    joins, more, adjust = "", "", ""
    for k, (t, d) in enumerate(taus, 1):
        base_name = f"tau={'+' if d == 'up' else '-'}{t:g}"
        joins += f" JOIN p{k} ON p{k}.target = b.target AND p{k}.gene = b.gene"
        more += f', p{k}.p AS "{base_name}_p", 2 * p{k}.u / p{k}.mn - 1 AS "{base_name}_Ueffect"'
        adjust += f', least(min("{base_name}_p" * many / rank_{k}) OVER (PARTITION BY target ORDER BY rank_{k} DESC ROWS UNBOUNDED PRECEDING), 1) AS "{base_name}_padj"'
    numbered = ", ".join([f'row_number() OVER (PARTITION BY target ORDER BY "p_value", feature) AS rank_0', *(f"row_number() OVER (PARTITION BY target ORDER BY \"tau={'+' if d == 'up' else '-'}{t:g}_p\", feature) AS rank_{k}" for k, (t, d) in enumerate(taus, 1))])
    order = ["target", "feature", "target_mean", "ref_mean", "target_ncells", "ref_ncells", "log2_fold_change", "p_value", "Ueffect", "p_adj"]
    for t, d in taus:
        n = f"tau={'+' if d == 'up' else '-'}{t:g}"
        order += [f"{n}_p", f"{n}_Ueffect", f"{n}_padj"]
    whole = {"target", "feature", "target_ncells", "ref_ncells"}
    final = ", ".join(c if " AS " in c else (f'"{c}"' if c in whole else f'round("{c}", {digits}) + 0e0 AS "{c}"') for c in (columns or order))
    grp = "c" if label == "grp" else "c AS (SELECT cell, " + label + " AS grp FROM c0)"
    base = base if label == "grp" else base.replace("c AS (", "c0 AS (", 1).rstrip().rstrip(",") + f",\n{grp},\n"
    return f"""WITH {base}{_LIB}{_values(total)}
f AS (SELECT * FROM (VALUES {', '.join(f'({k}, {s!r}e0)' for k, s, _ in factors)}) AS f(k, s)),
h AS (SELECT grp, gene, x, count(*) AS n FROM x GROUP BY ALL),
u AS (SELECT t.grp AS target, t.gene, k, sum(t.n * r.n * CASE WHEN r.x < t.x * s THEN 1e0 WHEN r.x = t.x * s THEN 5e-1 ELSE 0e0 END) AS u FROM h t JOIN h r ON t.gene = r.gene AND {apart} CROSS JOIN f GROUP BY ALL),
a AS (SELECT DISTINCT target FROM u),
pool AS (SELECT target, gene, k, v, sum(n) AS n FROM (SELECT grp AS target, gene, k, x * s AS v, n FROM h JOIN a ON a.target = grp CROSS JOIN f UNION ALL SELECT t.target, r.gene, k, r.x, r.n FROM a t JOIN h r ON {apart.replace('t.grp', 't.target')} CROSS JOIN f) GROUP BY ALL),
tie AS (SELECT target, gene, k, CAST(sum(CAST(n AS HUGEINT) * n * n - n) AS DOUBLE) AS tie FROM pool GROUP BY ALL),
q AS (SELECT grp, gene, count(*) AS m, {mean} AS mean, avg(raw) AS value, sum(raw) AS sum, avg(cpm) AS cpm_cell, sum(raw) / sum(CASE WHEN l = 0 THEN 1 ELSE l END) * 1e6 AS cpm_bulk FROM x GROUP BY ALL),
b AS (SELECT t.grp AS target, t.gene, t.m, sum(r.m) AS n, t.mean AS tm, sum(r.mean * r.m) / sum(r.m) AS rm, t.value AS t_value, sum(r.value * r.m) / sum(r.m) AS r_value, t.sum AS t_sum, sum(r.sum) AS r_sum, t.cpm_cell AS t_cpm_cell, sum(r.cpm_cell * r.m) / sum(r.m) AS r_cpm_cell, t.cpm_bulk AS t_cpm_bulk, max(r.cpm_bulk) AS r_cpm_bulk FROM q t JOIN q r ON t.gene = r.gene AND {apart} GROUP BY ALL),
k AS (SELECT u.target, u.gene, u.k, u, tie, CAST(m AS DOUBLE) AS m, CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) * n AS mn FROM u JOIN tie ON u.target = tie.target AND u.gene = tie.gene AND u.k = tie.k JOIN b ON b.target = u.target AND b.gene = u.gene),
{', '.join(p)},
j AS (SELECT {select}{more} FROM b JOIN g ON g.gene = b.gene JOIN p0 ON p0.target = b.target AND p0.gene = b.gene{joins} WHERE {where}),
i AS (SELECT *, count(*) OVER (PARTITION BY target) AS many, {numbered} FROM j),
r AS (SELECT *, least(min(p_value * many / rank_0) OVER (PARTITION BY target ORDER BY rank_0 DESC ROWS UNBOUNDED PRECEDING), 1) AS p_adj{adjust} FROM i)
SELECT {final} FROM r {tail}"""


def _empty(more: tuple[str, ...]) -> str:
    kinds = {"target": "VARCHAR", "feature": "VARCHAR", "target_ncells": "BIGINT", "ref_ncells": "BIGINT"}
    return "SELECT " + ", ".join(f'CAST(NULL AS {kinds.get(c, "DOUBLE")}) AS "{c}"' for c in (*COLUMNS, *more)) + " WHERE FALSE"


def _simple(select: str, total: str | None = None) -> str:
    return f"WITH {_M1}{_LIB}{_values(total).rstrip(',')} {select}"


def _passes(quantity: str, threshold: float) -> str:
    return f"(t_{quantity} > {threshold} OR r_{quantity} > {threshold})"


def _compared() -> str:
    """Both results whole, their columns one below the other, ranks by row numbers averaged over ties."""
    columns = ("target_mean", "ref_mean", "log2_fold_change", "p_value", "Ueffect", "p_adj")
    both = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", a.\"{c}\" AS a, b.\"{c}\" AS b FROM a JOIN b ON a.target = b.target AND a.feature = b.feature" for c in columns)
    return f"""WITH a AS ({_run()}), b AS ({_run(total='1e4', where=_passes('value', 20.0))}), p AS ({both}),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY a) AS ia, row_number() OVER (PARTITION BY "column" ORDER BY b) AS ib FROM p WHERE isfinite(a) AND isfinite(b)),
m AS (SELECT *, avg(ia) OVER (PARTITION BY "column", a) AS ra, avg(ib) OVER (PARTITION BY "column", b) AS rb FROM r),
k AS (SELECT (SELECT count(*) FROM a JOIN b ON a.target = b.target AND a.feature = b.feature) AS n_common, (SELECT count(*) FROM a ANTI JOIN b ON a.target = b.target AND a.feature = b.feature) AS only_a, (SELECT count(*) FROM b ANTI JOIN a ON a.target = b.target AND a.feature = b.feature) AS only_b)
SELECT "column", count(*) AS n, round(corr(a, b), 6) + 0e0 AS pearson, round(corr(ra, rb), 6) + 0e0 AS spearman, round(max(abs(a - b)), 6) + 0e0 AS largest, any_value(n_common) AS n_common, any_value(only_a) AS only_a, any_value(only_b) AS only_b FROM m, k GROUP BY 1"""


def _shifted(levels: tuple[float, ...], se: bool) -> str:
    """Shifts as order statistics: every pair of positive values, the largest ratio first, and U counted down to the level."""
    z = {f"tau*_p{q:g}": upper_quantile(q) for q in levels}
    asked = [f"({k}, {x!r}e0, 0)" for k, x in enumerate(z.values())]
    ends = [f"({len(z)}, {upper_quantile(SE_LEVEL)!r}e0, 1)", f"({len(z) + 1}, {upper_quantile(SE_LEVEL)!r}e0, -1)"] if se else []
    names = [*z, *(["tau*_lo_p0.025", "tau*_hi_p0.025"] if se else [])]
    picked = ", ".join(f'round(max(CASE WHEN k = {i} THEN s END), 9) + 0e0 AS "{n}"' for i, n in enumerate(names))
    spread = f', round(CASE WHEN isfinite(max(CASE WHEN k = {len(z)} THEN s END)) AND isfinite(max(CASE WHEN k = {len(z) + 1} THEN s END)) THEN (max(CASE WHEN k = {len(z) + 1} THEN s END) - max(CASE WHEN k = {len(z)} THEN s END)) / {2 * upper_quantile(SE_LEVEL)!r}e0 ELSE CAST(\'inf\' AS DOUBLE) END, 9) + 0e0 AS "tau*_se"' if se else ""
    return f"""WITH {_M1}{_LIB}{_values(None)}
h AS (SELECT grp, gene, x, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT grp, gene, sum(n) AS m, sum(CASE WHEN x = 0 THEN n ELSE 0 END) AS z, sum(CASE WHEN x > 0 THEN n * n * n - n ELSE 0 END) AS tie FROM h GROUP BY ALL),
d AS (SELECT t.grp AS target, t.gene, CAST(t.m AS DOUBLE) AS m, CAST(r.m AS DOUBLE) AS n, CAST(r.z AS DOUBLE) * (t.m - t.z) + t.z * r.z / 2e0 AS fixed, CAST((t.m - t.z) * (r.m - r.z) AS DOUBLE) AS pairs,
  CAST(t.tie + r.tie + (t.z + r.z) * (t.z + r.z) * (t.z + r.z) - t.z - r.z AS DOUBLE) AS tie FROM s t JOIN s r ON t.gene = r.gene AND t.grp <> '{REFERENCE}' AND r.grp = '{REFERENCE}'),
u AS (SELECT t.grp AS target, t.gene, sum(t.n * r.n * CASE WHEN r.x < t.x THEN 1e0 WHEN r.x = t.x THEN 5e-1 ELSE 0e0 END) AS u FROM h t JOIN h r ON t.gene = r.gene AND t.grp <> '{REFERENCE}' AND r.grp = '{REFERENCE}' GROUP BY ALL),
l AS (SELECT d.target, d.gene, k, pairs, CASE WHEN way > 0 THEN ceil(m * n / 2 + 5e-1 + z * sd - fixed) ELSE floor(m * n / 2 - 5e-1 - z * sd - fixed) + 1 END AS rank
  FROM (SELECT d.*, u, sqrt(greatest(m * n / 12 * ((m + n + 1) - tie / greatest((m + n) * (m + n - 1), 1)), 2.2250738585072014e-308)) AS sd FROM d JOIN u ON u.target = d.target AND u.gene = d.gene) d
  CROSS JOIN LATERAL (SELECT k, z, CASE WHEN f = 0 THEN CASE WHEN u >= m * n / 2 THEN 1 ELSE -1 END ELSE f END AS way FROM (VALUES {', '.join(asked + ends)}) AS q(k, z, f)) q),
p AS (SELECT t.grp AS target, t.gene, t.x / r.x AS ratio, CAST(sum(t.n * r.n) AS DOUBLE) AS n FROM h t JOIN h r ON t.gene = r.gene AND t.grp <> '{REFERENCE}' AND r.grp = '{REFERENCE}' AND t.x > 0 AND r.x > 0 GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY target, gene ORDER BY ratio DESC ROWS UNBOUNDED PRECEDING) AS upto FROM p),
a AS (SELECT l.target, l.gene, l.k, CASE WHEN rank <= 0 THEN CAST('inf' AS DOUBLE) WHEN rank > pairs THEN CAST('-inf' AS DOUBLE) ELSE log2(max(ratio)) END AS s
  FROM l LEFT JOIN w ON w.target = l.target AND w.gene = l.gene AND upto >= rank GROUP BY l.target, l.gene, l.k, rank, pairs)
SELECT target, gene AS feature, {picked}{spread} FROM a GROUP BY ALL"""


_BOTH = _run()
_SCALED = "SELECT x.cell AS cell_id, gene AS feature, round(x, 4) + 0e0 AS value FROM x WHERE raw <> 0"
_LABEL = f"CASE WHEN starts_with(grp, 'MA') THEN '{REFERENCE}' ELSE grp END"
SQL: dict[str, str] = {
    "mwu_ref": _BOTH,
    "mwu_external_ref": _BOTH,
    "byo_cell_source": _BOTH,
    "byo_array_groups": _BOTH,
    "archive_shard": _BOTH,
    "archive_cell": _BOTH,
    "archive_targets": f"SELECT * FROM ({_BOTH}) WHERE target IN ('MACHINERY', 'FURNITURE')",
    "archive_groups": f"WITH {_M3.strip().rstrip(',')} SELECT grp AS \"group\", count(DISTINCT c.cell) AS n_cells, count(v) AS n_entries, grp = '{REFERENCE}' AS is_reference FROM c LEFT JOIN e ON e.cell = c.cell GROUP BY 1",
    "csr_arrays": _BOTH,
    "csr_chunks": f"WITH {_M3.strip().rstrip(',')} SELECT cell AS customer, gene AS feature, v AS value FROM e WHERE v <> 0",
    "stream_arrivals": _BOTH,
    "stream_parts": _BOTH,
    "mwu_all_others": _run(rest=True),
    "library_size": _simple("SELECT cell AS cell_id, l AS library_size FROM lib"),
    "target_sum_median": _simple("SELECT median(l) AS target_sum FROM lib WHERE l > 0"),
    "group_counts": "SELECT c_mktsegment AS \"group\", count(*) AS n_cells FROM customer GROUP BY 1",
    "group_means_arith": _run(columns=["target", "feature", "target_mean", "ref_mean"]),
    "group_means_geom": _run(geometric=True, columns=["target", "feature", "target_mean", "ref_mean"]),
    "normalize_cpm": _simple(_SCALED, "1e6"),
    "normalize_median": _simple(_SCALED, _MEDIAN),
    "log1p_normalize": _simple("SELECT x.cell AS cell_id, gene AS feature, round(ln(1 + x), 5) + 0e0 AS value FROM x WHERE raw <> 0", "1e4"),
    "mwu_normalized": _run(total="1e4"),
    "mwu_median": _run(total=_MEDIAN),
    "noncount_check": f"WITH {_M1.replace('e AS', 'e1 AS').replace('c AS', 'c1 AS').replace('FROM e)', 'FROM e1)').replace('g AS', 'g1 AS')}{_M2.strip().rstrip(',')} SELECT (SELECT bool_or(v < 0 OR abs(v - round_even(v, 0)) > 1e-6) FROM e1) AS counts, (SELECT bool_or(v < 0 OR abs(v - round_even(v, 0)) > 1e-6) FROM e) AS vectors",
    "ref_tie_term": _simple(f"SELECT gene AS feature, CAST(sum(n * n * n - n) AS BIGINT) AS tie FROM (SELECT gene, x, count(*) AS n FROM x WHERE grp = '{REFERENCE}' GROUP BY ALL) GROUP BY gene"),
    "pooled_tie_term": _simple(f"SELECT target, gene AS feature, CAST(sum(n * n * n - n) AS BIGINT) AS tie FROM (SELECT t.grp AS target, gene, x, count(*) AS n FROM (SELECT DISTINCT grp FROM c WHERE grp <> '{REFERENCE}') t JOIN x ON x.grp IN (t.grp, '{REFERENCE}') GROUP BY ALL) GROUP BY ALL"),
    "u_stat_ref": _simple(f"SELECT t.grp AS target, t.gene AS feature, sum(CASE WHEN r.x < t.x THEN 1e0 WHEN r.x = t.x THEN 5e-1 ELSE 0e0 END) AS u FROM x t JOIN x r ON t.gene = r.gene AND t.grp <> '{REFERENCE}' AND r.grp = '{REFERENCE}' GROUP BY ALL"),
    "u_stat_rest": _simple("SELECT t.grp AS target, t.gene AS feature, sum(CASE WHEN r.x < t.x THEN 1e0 WHEN r.x = t.x THEN 5e-1 ELSE 0e0 END) AS u FROM x t JOIN x r ON t.gene = r.gene AND t.grp <> r.grp GROUP BY ALL"),
    "effect_size": _run(columns=["target", "feature", "Ueffect"]),
    "log2fc": _run(columns=["target", "feature", "log2_fold_change"]),
    "log2fc_eps0": _run(epsilon=0.0, columns=["target", "feature", "log2_fold_change"]),
    "filter_mean": _run(where=_passes("value", 20.0)),
    "filter_total": _run(where=_passes("sum", 6000.0)),
    "filter_cpm_cell": _run(where=_passes("cpm_cell", 41_000.0)),
    "filter_cpm_bulk": _run(where=_passes("cpm_bulk", 40_500.0)),
    "keep_genes": _run(where="idx % 3 = 0"),
    "bh_fdr": """WITH p AS (SELECT o_orderstatus AS target, o_orderkey, (CAST(round(o_totalprice * 100) AS BIGINT) % 100003) / 100003e0 AS p FROM orders),
        r AS (SELECT *, count(*) OVER (PARTITION BY target) AS m, row_number() OVER (PARTITION BY target ORDER BY p, o_orderkey) AS i FROM p)
        SELECT target, o_orderkey, round(p, 9) + 0e0 AS p, round(least(min(m * p / i) OVER (PARTITION BY target ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1), 9) + 0e0 AS p_adj FROM r""",
    "special_functions": f"SELECT c_custkey, round(z, 10) + 0e0 AS z, round({erfc_sql('z')}, 10) + 0e0 AS erfc FROM (SELECT c_custkey, CAST(c_acctbal / 1500e0 AS DOUBLE) AS z FROM customer)",
    "tau_star": _shifted((0.05, 0.5), False),
    "tau_star_se": _shifted((0.5,), True),
    "empty_schema": _empty(("tau=+0.5_p", "tau=+0.5_Ueffect", "tau=+0.5_padj")),
    "mwu_sparse": _run(base=_M3),
    "mwu_prepared_ref": _run(taus=[(t, d) for t in GRID for d in ("up", "down")]),
    "lfc_up_down_grid": _run(taus=[(t, d) for t in GRID for d in ("up", "down")]),
    "output_columns": _run(columns=["feature AS gene", "target AS feature", "round(p_adj, 9) + 0e0 AS q"]),
    "topk_hits": f"SELECT * FROM ({_run(columns=['target', 'feature', 'p_adj'])}) ORDER BY p_adj, target, feature LIMIT 5",
    "rank_of_gene": f"SELECT * FROM (SELECT target, feature, CAST(row_number() OVER (PARTITION BY target ORDER BY p_value, feature) AS INTEGER) AS place, p_value FROM ({_run(columns=['target', 'feature', 'p_value'])})) WHERE feature = 'Brand#11'",
    "collapse_reference": _run(label=_LABEL),
    "result_compare": _compared(),
    "top_genes_sample": _simple("SELECT gene AS feature, sum(raw) AS total FROM x JOIN (SELECT cell, row_number() OVER (PARTITION BY grp ORDER BY md5(CAST(cell AS VARCHAR)), cell) AS r FROM c) s ON s.cell = x.cell AND r <= 20 GROUP BY gene ORDER BY total DESC, feature LIMIT 10"),
    "mwu_vectors": _run(base=_M2, reference="0", digits=8),
}
