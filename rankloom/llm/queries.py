"""Queries that apply each training-data operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, negatives, secrets, sharding, topk, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit(url_filter.FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(url_filter.DAYS)).cast("int"))
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages.select("page_id", "url", day.alias("day")), url_filter.query_entries(pages))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(licenses.PATH).alias("path"), "text")
    found = licenses.scan(files)
    return found.select(F.regexp_extract("path", "([0-9]+)(\\.txt)?$", 1).cast("long").alias("doc_id"), "path", "own", "score", "inherited", "license")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    findings, _ = scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    return digest(findings)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import train

    docs = table(spark, sf_dir, "documents")
    return train(docs, table(spark, sf_dir, "labels")).judge(docs)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode

    done = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

    def digest(numbers: str) -> Column:
        return F.sha2(F.concat_ws(" ", F.col(numbers).cast("array<string>")), 256)

    # Pieces lie end to end: where they end says where they begin, but for pieces of no bytes.
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("n_source_bytes"), digest("ends").alias("ends_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 16)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    from .shared import shared_path

    path = shared_path(spark, "warc")
    warc.write(warc.captures(table(spark, sf_dir, "pages")), path)
    return warc.resolved(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, words

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    done = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_topk": op6_topk,
    "op7_rendezvous": op7_rendezvous,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_mixing": op11_mixing,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op2_licenses": licenses.SQL,
    "op4_warc": warc.SQL,
    "op6_topk": topk.SQL,
    "op7_rendezvous": sharding.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op9_secrets": secrets.SQL,
    "op13_hard_negatives": negatives.SQL,
}
