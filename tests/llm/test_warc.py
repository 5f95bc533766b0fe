import glob
import gzip
import hashlib
import zlib
from collections import Counter

import pytest

from rankloom.llm import warc


def plain(rows, least=100):
    def sha(h):
        return hashlib.sha256((h or "").encode()).hexdigest()

    out = []
    for page, _, html, *_ in rows:
        size = len((html or "").encode())
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        revisit = size >= least and first is not None and page != first
        out.append((page, size, sha(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def got(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(records).collect()), key=str)


ROWS = [(5, "http://a/b c\r\nX: 1", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 9, "x"), (3, None, "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 9, None), (3, "u", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 9, "y"), (1, "u", None, "z"), (2, "u", "", "z"), (9, "u", "small", ""), (8, "u", "small", ""), (None, "u", "z" * 100, ""), (4, "u", "z" * 100, ""), (None, "n", "q" * 200, ""), (None, "n", "q" * 200, ""), (7, "u", "w" * 99, ""), (6, "u", "w" * 99, ""), (10, "u", "\0" + "long" * 500_000, "")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/one"
    warc.write(warc.captures(df), path, records_per_file=3)
    assert got(warc.read(spark, path)) == plain(ROWS)
    back = {(r.page_id, r.url): bytes(r.payload) for r in warc.read(spark, path, payloads=True).where("record_type = 'response'").collect()}
    assert back[(10, "u")] == ROWS[-1][2].encode() and back[(1, "u")] == b""
    assert all(r.intact for r in warc.read(spark, path).collect())
    warc.write(warc.captures(df.limit(0)), f"file://{tmp_path}/none")
    assert got(warc.read(spark, f"file://{tmp_path}/none")) == []


def test_merge_resolves_across_archives(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string").where("page_id is not null")
    more = [(20, "u", "z" * 100, ""), (21, "u", "new" * 50, ""), (0, "u", "new" * 50, "")]
    warc.write(warc.captures(df), f"file://{tmp_path}/a")
    warc.write(warc.captures(spark.createDataFrame(more, df.schema)), f"file://{tmp_path}/b")
    warc.merge(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"], f"file://{tmp_path}/c")
    assert got(warc.read(spark, f"file://{tmp_path}/c")) == plain([r for r in ROWS if r[0] is not None] + more)


def test_members_and_damage():
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{}\r\n\r\n"
    one = head.format(len("HTTP/1.1 200 OK\r\n\r\n") + 3, "abc").encode()
    pack = zlib.compressobj(wbits=31)
    member = pack.compress(one) + pack.flush()
    found = list(warc._parsed(warc._inflated(member * 3)))
    assert len(found) == 3 and all(b.endswith(b"abc") for _, b in found)


def test_archives_are_plain_warc_to_other_readers(spark, tmp_path):
    """Members one by one: each record begins at one, after a warcinfo; revisits name their response."""
    path = f"{tmp_path}/one"
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    warc.write(warc.captures(df.repartition(1), "2020-02-02T00:00:00Z"), f"file://{path}", records_per_file=4, large=1000)
    files = [f for f in glob.glob(f"{path}/**/part-*", recursive=True)]
    assert len(files) > 4
    kinds, ids = Counter(), set()
    for f in files:
        data = open(f, "rb").read()
        assert gzip.decompress(data) == warc._inflated(data)
        while data:
            member = zlib.decompressobj(31)
            text = member.decompress(data)
            assert text.startswith(b"WARC/1.1\r\n") or text == b"\r\n\r\n"
            data = member.unused_data
        for head, _ in warc._parsed(warc._inflated(open(f, "rb").read())):
            kinds[head["warc-type"]] += 1
            ids.add(head["warc-record-id"])
            if head["warc-type"] == "revisit":
                assert {"warc-refers-to", "warc-refers-to-date", "warc-profile"} <= set(head) and head["warc-date"] == "2020-02-02T00:00:00Z"
    assert kinds["warcinfo"] >= 1 and kinds["response"] + kinds["revisit"] == len(ROWS)


def test_damage_is_told(spark, tmp_path):
    whole = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n"
    for data in (whole + b"short", b"GET / HTTP/1.1\r\n\r\n", b"WARC/1.0\r\nno end", b"WARC/1.0\r\nX: 1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc._parsed(data))


def test_query(spark):
    import pyarrow.parquet as pq

    from rankloom.llm.queries import QUERIES

    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    result = QUERIES["op4_warc"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in result), key=str) == plain(rows)
