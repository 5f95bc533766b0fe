"""From raw documents to token ids: classify, deduplicate, decontaminate, redact, encode.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm import decontaminate, pieces, quality, secrets, simhash
from rankloom.llm.shared import divided, shared_path, stored

MODEL = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is trained on trusted documents among these."""
    return quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).kept(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the rows with its smallest id, one for each fingerprint; rows without an id stay.

    Rows are judged by id and fingerprint, so that an id on two texts cannot save a copy.  Of rows
    equal in both, the one with the least text stays.
    """
    found = simhash.near_duplicates(docs)
    id_ = F.col("doc_id").cast("long")
    named = docs.where("doc_id is not null")
    # An id that stands once says which row is meant; only where one repeats, fingerprints are made again to tell its rows apart.
    several, once = divided(docs, id_, named.groupBy(id_.alias("d")).agg(F.count("*").alias("n")).where("n > 1").select("d"))
    _, first = divided(once, id_, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    several = stored(several.withColumn("_row", F.monotonically_increasing_id()))
    prints = simhash.fingerprints(several.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_of"), F.col("fp").alias("_fp"))
    firsts = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_own")).distinct()
    apart = several.join(prints, F.col("_row") == F.col("_of")).join(firsts, (id_ == F.col("_id")) & (F.col("_fp") == F.col("_own")))
    order = Window.partitionBy("_id", "_own").orderBy(F.coalesce("text", F.lit("")), "_row")
    kept = apart.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return first.unionByName(kept.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark text to the contract's extent."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    doubtful, clean = divided(docs, F.xxhash64("doc_id", F.xxhash64("text")), bad.select(F.xxhash64("_id", "_hash")))
    return clean.unionByName(doubtful.join(bad, doubtful["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(doubtful["text"]) == F.col("_hash")), "left_anti"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mask; ``n_chars`` follows."""
    _, entries = secrets.scan(docs.select(F.col("doc_id").alias("path"), "text"))
    hits = stored(entries.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")))
    # Documents without a secret stay where they are.
    held, free = divided(docs, F.xxhash64(secrets.blob_of(docs["text"])), hits.select(F.xxhash64("_blob")))
    joined = held.join(hits, secrets.blob_of(held["text"]) == F.col("_blob"), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("_spans")))
    masked = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return free.unionByName(masked.select(*docs.columns))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hash of what they decode to."""
    done = pieces.encode(docs, public_tokenizers.path(MODEL))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding", encode_stage),
]

#: Model training and fingerprints of 64-bit hashes are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet to the shared folder and the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
