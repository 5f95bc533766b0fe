"""Target groups that arrive as files, tested against a static reference pool.

Targets are independent given the reference and adjusted p-values stay within a target, so each
micro-batch is a run of its own.  The pool is prepared once, before the first batch; no batch
reads it again.  A group may arrive in parts: what is kept of each batch is a row for each group
(cells and totals) and its histogram by gene and value.  These add up, so a batch reads again the
sums of the groups that it touches, never their cells, and ranks those groups alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..api import Study, Sums, added, ranked, summed
from ..plans.spec import Spec
from ..sources.matrix import CountMatrix
from ..sources.places import stored
from ..sources.reference import Reference, prepare

#: A row for each entry; a cell without entries has one row with a null gene.
ARRIVAL = "cell_id long, group string, gene_idx int, value double"


def arrivals(matrix: CountMatrix, column: str) -> DataFrame:
    """A matrix in the form that ``watch`` reads."""
    cells = matrix.cells.select("cell_id", F.col(column).cast("string").alias("group"))
    return cells.join(matrix.entries, "cell_id", "left").select("cell_id", "group", F.col("gene_idx").cast("int"), F.col("value").cast("double"))


def watch(spark: SparkSession, source: str, pool: CountMatrix | Reference, out: str, checkpoint: str, spec: Spec | None = None, files_per_batch: int = 8) -> StreamingQuery:
    """Test the groups in each new Parquet file below ``source``; each batch writes its results to a folder of its own below ``out``.

    A group's rows are those of the last batch that touched it: ``results`` shows them.  The rows
    of a cell must arrive in one batch, and a cell that comes again is a ValueError, as it would
    count twice.  Batches that are replayed after a failure overwrite their own folders and add up
    earlier batches only.  A pool that is not prepared yet is prepared below ``out``, for the
    target sum of ``spec``.
    """
    spec = spec or Spec()
    if spec.output_columns is not None and "target" not in spec.output_columns:
        raise ValueError("output_columns must keep the target: a group's last results are found by it")
    reference = pool if isinstance(pool, Reference) else prepare(pool, f"{out}/reference-{uuid.uuid4().hex}", spec.total)

    def kept(name: str, number: int, like: DataFrame) -> DataFrame:
        schema = StructType([*like.schema.fields, StructField("batch", IntegerType())])
        return spark.read.schema(schema).parquet(f"{out}/state/{name}").where(F.col("batch") <= number)

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        cells = batch.select("cell_id", "group").distinct()
        cells.write.mode("overwrite").parquet(f"{out}/state/cells/batch={number}")
        known = kept("cells", number, cells)
        cells = known.where(F.col("batch") == number).drop("batch")
        if not cells.join(known.where(F.col("batch") < number), ["group", "cell_id"], "left_semi").isEmpty():
            raise ValueError("a cell arrived again: every cell must come once")
        study = Study(batch.where("gene_idx is not null").select("cell_id", "gene_idx", "value"), cells.withColumn("side", F.lit(0)), reference.genes, reference=reference)
        sums, total = summed(study, spec)
        for name in ("groups", "seen"):  # in order of groups, so that later batches skip what they do not touch
            getattr(sums, name).repartitionByRange("group").sortWithinPartitions("group").write.mode("overwrite").parquet(f"{out}/state/{name}/batch={number}")
        groups = kept("groups", number, sums.groups)
        touched = groups.where(F.col("batch") == number).select("group")
        sums = Sums(groups.join(touched, "group", "left_semi"), kept("seen", number, sums.seen).join(touched, "group", "left_semi"))
        whole = added(sums)
        ranked(study, Sums(whole.groups, stored(whole.seen)), spec, total).write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        touched.write.mode("overwrite").parquet(f"{out}/groups/batch={number}")  # last: the results count from here on

    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str, target: str = "target") -> DataFrame:
    """The rows of every group that ``watch`` has written to ``out``, each from the last batch that touched it.

    ``target`` is the column of labels, where ``output_columns`` gave it another name.
    """
    last = spark.read.parquet(f"{out}/groups").groupBy(F.col("group").alias(target)).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/results").join(last, [target, "batch"], "left_semi").drop("batch")
