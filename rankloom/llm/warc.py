"""WARC archives: writing, reading, and resolving revisit records.

Headers (page, digest and size) are shuffled by payload digest to decide which records revisit
which; payloads stay where they are.  Every record is a gzip member of its own.  Spark's text sink
writes them, to any file system that Spark reaches: a row is the record's member, and the line
separator is a member that holds the two line breaks which end every record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import divided, stored

LEAST_BYTES = 100  # smaller payloads are not worth a revisit record
RECORDS_PER_FILE = 256  # of at most LARGE bytes; a larger record has a file of its own
LARGE = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE = "rankloom"
_BREAK = "\r\n"
_RECORD = "page_id long, record_id string, record_type string, url string, date string, refers_to_record string, payload_digest string, payload_bytes long, intact boolean"


def captures(pages: DataFrame, date: str | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` to captures with the payload's digest and size; null html is empty.

    ``date`` is the time of all captures (now, if not given); a column ``date`` of the pages goes before it.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    given = F.lit(date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    when = F.coalesce(F.col("date").cast("string"), given) if "date" in pages.columns else given
    return pages.select("page_id", "url", when.alias("date"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def _urn(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def _header(name: str, value: Column) -> Column:
    """A header line; none for null.  A header ends with its line, so breaks and blanks are written as %20."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20"), F.lit(_BREAK)), F.lit(""))


def _record() -> Column:
    revisit = F.col("first_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=UTF-8{_BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(_BREAK * 2))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    first = _urn(F.col("first_id"), F.col("digest"))
    return F.concat(
        F.lit(f"WARC/1.1{_BREAK}"), _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), _urn(F.col("page_id"), F.col("digest")), F.lit(">"))), _header("WARC-Date", F.col("date")), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _header("WARC-Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{_BREAK}"), _header("WARC-Refers-To", F.concat(F.lit("<"), first, F.lit(">"))), _header("WARC-Refers-To-Target-URI", F.col("first_url")), _header("WARC-Refers-To-Date", F.col("first_date")))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{_BREAK}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_BREAK * 2), body)


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(wbits=31)
    return pack.compress(data) + pack.flush()


_SEPARATOR = _member((_BREAK * 2).encode())


def _members(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member, behind one that tells what wrote them."""
    told = False
    for batch in batches:
        out = []
        if not told and batch.num_rows:
            told, context = True, TaskContext.get()
            fields = f"software: {SOFTWARE}{_BREAK}format: WARC File Format 1.1{_BREAK}"
            name = hashlib.md5(f"{context.stageId()}/{context.partitionId()}/{date}".encode()).hexdigest()
            urn = "-".join(name[i:j] for i, j in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
            out.append(_member(f"WARC/1.1{_BREAK}WARC-Type: warcinfo{_BREAK}WARC-Record-ID: <urn:uuid:{urn}>{_BREAK}WARC-Date: {date}{_BREAK}Content-Type: application/warc-fields{_BREAK}Content-Length: {len(fields)}{_BREAK * 2}{fields}".encode()))
        out += [_member(x.as_buffer()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def decided(found: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``found`` with ``first_id``, ``first_url`` and ``first_date`` of the response that a record revisits, else nulls.

    Only headers are shuffled by digest; rows whose digest repeats find their response in the
    table of repeated digests.
    """
    large = found.where(F.col("bytes") >= least_bytes)
    first = F.min(F.when(F.col("page_id").isNotNull() & F.col("payload").isNotNull(), F.struct("page_id", "date", "url"))).alias("first")
    heads = stored(large.groupBy(F.col("digest").alias("d")).agg(first, F.count("*").alias("copies")).where("copies > 1 and first is not null").select("d", "first"))
    some, alone = divided(found, F.xxhash64("digest"), heads.select(F.xxhash64("d")))
    names = {"first_id": "page_id", "first_url": "url", "first_date": "date"}
    some = some.join(heads, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), "left")
    types = dict(found.dtypes)
    return some.select(*found.columns, *(F.col(f"first.{c}").alias(n) for n, c in names.items())).unionByName(alone.select("*", *(F.lit(None).cast(types[c]).alias(n) for n, c in names.items())))


def write(found: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE, large: int = LARGE) -> None:
    """Write captures as a deduplicated archive with fresh headers, below ``path``.

    Of equal payloads of ``least_bytes`` and more the smallest page id is a response (rows that
    repeat it too: they are one record, with one id), all others are revisits of it.  A capture
    without a payload (null: an earlier revisit) is never the response.  A file holds a bounded
    number of bytes, or one record of more than ``large`` bytes.
    """
    whole, date = decided(found, least_bytes), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    for name, part, many in (("records", F.col("bytes") <= large, records_per_file), ("large", F.col("bytes") > large, 1)):
        members = whole.where(part).select(_record().cast("binary").alias("record")).mapInArrow(lambda it: _members(it, date), "value binary")
        members.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", _SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", many).text(f"{path}/{name}")


def _inflated(content: bytes) -> bytes:
    out = []
    while content:  # one member for the file, or one for each record
        member = zlib.decompressobj(31)
        out += [member.decompress(content), member.flush()]
        content = member.unused_data
    return b"".join(out)


def _parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; a record that is no WARC record or ends early is a ValueError."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        version, *lines = data[at:max(stop, at)].decode("utf-8", "replace").split(_BREAK)
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}: {data[at:at + 40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = stop + 4
        end = begin + int(head.get("content-length", -1))
        if not begin <= end <= len(data):
            raise ValueError(f"the WARC record at byte {at} ends early or names no length")
        yield head, data[begin:end]
        at = end + 4


def _read_batches(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            rows = []
            for head, block in _parsed(_inflated(data) if data[:2] == b"\x1f\x8b" else data):
                kind = head["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                digest = head.get("warc-payload-digest", "").rpartition(":")[2]
                own = None if payload is None else hashlib.sha256(payload).hexdigest()
                page = head.get("warc-page-id")
                rows.append((None if page is None else int(page), head["warc-record-id"].strip("<>"), kind, head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to", "").strip("<>") or None, own or digest, None if payload is None else len(payload), own is None or own == digest, *([payload] if payloads else [])))
            if rows:
                types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.bool_(), *([pa.binary()] if payloads else [])]
                names = [x.split()[0] for x in _RECORD.split(", ")] + ["payload"] * payloads
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Response and revisit records of the archives below ``path``, gzip or plain; a task holds one file at a time.

    A file that is damaged ends the job with a ValueError.  ``intact`` tells whether a response's payload has the digest its header names; the digest
    returned is the payload's own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,txt,warc}").load(path).select("content")
    return files.mapInArrow(lambda it: _read_batches(it, payloads), _RECORD + (", payload binary" if payloads else ""))


def resolved(records: DataFrame) -> DataFrame:
    """Join revisit records to the responses they refer to: full size and page of the original.

    A row for each record; a revisit whose response is not among them has null size and page and
    is not intact.  Responses that repeat an id count once.
    """
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("r"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest")).dropDuplicates(["r"])
    joined = records.join(first, F.col("refers_to_record") == F.col("r"), "left")
    return joined.select("page_id", "url", "date", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first_page").alias("refers_to"), (F.col("intact") & F.coalesce(F.col("first_digest") == F.col("payload_digest"), F.col("record_type") == "response")).alias("intact"))


def merge(spark: SparkSession, sources: list[str], path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Rewrite archives as one, revisits resolved across all of them and every header fresh.

    Records with equal payloads in different archives become one response and revisits of it.
    Revisits without their response in any source are an error of the sources; they are written as
    responses without payload.
    """
    records = read(spark, sources[0], payloads=True)
    for source in sources[1:]:
        records = records.unionByName(read(spark, source, payloads=True))
    known = resolved(records.drop("payload")).where("record_type = 'revisit'")
    held = records.where("record_type = 'response'").select("page_id", "url", "date", F.col("payload").cast("string").alias("payload"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"))
    write(held.unionByName(known.select("page_id", "url", "date", F.lit(None).cast("string").alias("payload"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"))), path, least_bytes)


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d
"""
