"""Weighted rendezvous hashing of record keys, in DataFrame operations only.

A record goes to the shard with the least ``-ln(u) / weight``, u a hash of key and shard.  A new
shard changes no other shard's value, so it only takes records into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

CHUNKS = 1024  # parts of a shard that are numbered apart; shards x CHUNKS sums are all that is broadcast
_BLOCK = 4096


_BITS = 52  # of an MD5 that make a number between 0 and 1


def _number(*parts: Column, digits: int) -> Column:
    """The first hexadecimal digits of the MD5 of values in writing, as a number; a null writes nothing."""
    text = F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rendezvous(key: Sequence[str], weights: Sequence[float]) -> Column:
    """The shard, from 0, of a record with the key columns given; weights are positive."""
    def cost(shard: int, weight: float) -> Column:
        u = (_number(*(F.col(c) for c in key), F.lit(shard), digits=_BITS // 4).cast("double") + 0.5) / float(1 << _BITS)
        return F.struct((-F.log(u) / weight).alias("cost"), F.lit(shard).alias("shard"))

    if len(weights) == 1:
        return F.lit(0)
    return F.least(*(cost(j, w) for j, w in enumerate(weights)))["shard"]


def shard(docs: DataFrame, weights: Sequence[float], chunks: int = CHUNKS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``.

    ``slot`` numbers the rows of a shard from 0 without gaps, by chunk, id, size and checksum.
    ``grown_shard`` is the shard with one more of weight 1.  Null text: size 1, the checksum of
    nothing; a null id is a key of its own.  Repeated rows each have a slot.  Rows equal in all
    that is numbered are counted before the shuffle, so no id or text is hot.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = cut(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")))
    placed = rows.withColumn("shard", rendezvous(["doc_id"], weights)).withColumn("grown_shard", rendezvous(["doc_id"], [*weights, 1.0])).withColumn("chunk", _number(F.col("doc_id"), F.col("size"), F.col("text_crc32"), digits=7) % chunks)
    sums = placed.groupBy("shard", "chunk").agg(F.sum("copies").alias("many"))
    starts = sums.select("shard", "chunk", (F.sum("many").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("many")).alias("start"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("before", F.sum("copies").over(inside) - F.col("copies")).join(F.broadcast(starts), ["shard", "chunk"])
    each = numbered.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_BLOCK})"))).withColumn("own", F.explode(F.expr(f"sequence(block * {_BLOCK}, least(copies, (block + 1) * {_BLOCK}) - 1)")))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("start") + F.col("before") + F.col("own")).alias("slot"), F.col("grown_shard").cast("int"))


def _sql(shards: int) -> str:
    """The query's law, and slots by one row number; the checksum goes byte by byte over a table made from its polynomial."""
    def nearest(many: int) -> str:
        u = f"(CAST('0x' || substr(md5(concat(doc_id, '/', j)), 1, {_BITS // 4}) AS BIGINT) + 5e-1) / {float(1 << _BITS)!r}"
        return f"list_aggregate(list_transform(range({many}), lambda j: {{'cost': -ln({u}), 'shard': j}}), 'min')['shard']"

    return f"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
b AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM b, k),
d AS (SELECT *, {nearest(shards)} AS shard, {nearest(shards + 1)} AS grown_shard, CAST('0x' || substr(md5(concat(doc_id, '/', size, '/', text_crc32)), 1, 7) AS BIGINT) % {CHUNKS} AS chunk FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY chunk, doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM d
"""


SQL = _sql(16)
