import zlib
from collections import Counter

from rankloom.llm.sharding import shard


def run(spark, rows, weights, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, shard int")
    return shard(df, weights, **more).collect()


def check(got, rows, weights):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by_key, slots = {}, {}
    for r in got:
        assert by_key.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, len(weights)) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_cases(spark):
    rows = [(1, "é", "a", 1), (1, "é", "b", 2), (1, "other", "", None), (None, None, None, 3), (None, "x", "", 0), (5, "", "", 0), (6, "long " * 100_000, "", 0)]
    rows += [(9, "copy", "", 0)] * 9000
    check(run(spark, rows, [1.0] * 4), rows, [1.0] * 4)
    check(run(spark, rows, [1.0] * 4, chunks=1), rows, [1.0] * 4)
    assert {r.shard for r in run(spark, rows, [1.0])} == {0}
    assert run(spark, [], [1.0, 2.0]) == []


def test_weights_and_growth(spark):
    rows = [(i, str(i), "", 0) for i in range(20_000)]
    weights = [1.0, 2.0, 1.0]
    got = run(spark, rows, weights)
    check(got, rows, weights)
    many = Counter(r.shard for r in got)
    assert abs(many[1] / 20_000 - 0.5) < 0.02 and abs(many[0] / 20_000 - 0.25) < 0.02
    moved = sum(r.grown_shard == 3 for r in got)
    assert abs(moved / 20_000 - 0.2) < 0.02
    grown = {r.doc_id: r.shard for r in run(spark, rows, [*weights, 1.0])}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)


def test_query(spark):
    import pyarrow.parquet as pq

    from rankloom.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    got = QUERIES["op7_rendezvous"](spark, "/root/testdata/sf0.01").collect()
    check(got, rows, [1.0] * 16)
