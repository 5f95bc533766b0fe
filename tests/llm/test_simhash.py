import random
import re

import numpy as np
import xxhash

from rankloom.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows of (doc_id, fingerprint): the smallest id reachable over links of at most 3 bits."""
    ids = {}
    for d, f in rows:
        ids.setdefault(f, []).append(d)
    fps = list(ids)
    a = np.array(fps, np.uint64)
    left, label = set(range(len(fps))), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist():
                if j in left:
                    left.discard(j)
                    todo.append(j)
        low = min(min(ids[fps[i]]) for i in group)
        label.update({fps[i]: low for i in group})
    return sorted((d, f"{f:016x}", label[f]) for d, f in rows)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int, fp string")
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, **more).collect())


def test_fingerprint_cases():
    rng = random.Random(1)
    words = ["The", "É", "é", "a", "b", " x", "Zz", "ß"]
    for n in (0, 1, 2, 3, 4, 50, 70_000):
        t = rng.choice([" ", "\t", "\n "]).join(rng.choices(words, k=n))
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 300, 900):
        value = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for k in range(n // 3):  # balls around some of them
            value[n - 1 - k] = value[k % max(1, n // 20)] ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 3)))
        value = np.unique(value)
        node = rng.integers(0, 3, len(value))
        index = simhash.GrayIndex(node, value)
        root = index.forest(3).roots(np.arange(len(value)))
        where = {int(v): i for i, v in enumerate(index.value)}
        for g in range(3):
            own = value[node == g]
            want = plain_components([(int(v), int(v)) for v in own])
            label = {int(f, 16): c for _, f, c in want}
            for v in own.tolist():
                for w in own.tolist():
                    assert (root[where[v]] == root[where[w]]) == (label[v] == label[w])


def test_cases(spark):
    rows = [(5, None, 1, "x"), (3, "", 2, None), (9, "one two", 3, "x"), (9, "one two", 3, "x"), (1, "one  TWO", 3, "y"), (2, "a b c d e f", None, ""), (4, "long " * 50_000, 1, "")]
    assert run(spark, rows) == plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    assert run(spark, []) == []


def test_documents_and_hot_nodes(spark):
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    rng = random.Random(5)
    words = docs[0]["text"].split()[:150]
    rows = [(d["doc_id"], d["text"], 0, "") for d in docs]
    for i in range(300):  # near copies: many distinct fingerprints in few coarse nodes
        t = list(words)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = str(rng.random())
        rows.append((100_000 + i, " ".join(t), 0, ""))
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    assert run(spark, rows) == want
    assert run(spark, rows, node_limit=16) == want


def test_members_of_hot_nodes_are_dealt_in_proportion(spark, monkeypatch):
    """Twice the fingerprints in one node: about twice the rows, not four times; and many of them in one task's pieces."""
    dealt = []
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 1 << 20, 6000).astype(np.int64) + (0x5A5A << 40))
    for many in (1000, 2000, 4000):
        df = spark.createDataFrame([(int(x),) for x in pool[:many]], "fp long")
        monkeypatch.setattr(simhash, "_link_batches", lambda it, bits: (b.select(["node", "fp"]).rename_columns(["a", "b"]) for b in it))
        dealt.append(simhash.links(df, 64).count())
        monkeypatch.undo()
    assert dealt[2] < 3 * dealt[1] < 9 * dealt[0]
    monkeypatch.setattr(simhash, "_ROWS", 50)
    prints = [(i, int(x)) for i, x in enumerate(pool[:1500])]
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: df)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, node_limit=64).collect())
    assert got == plain_components([(d, f) for d, f in prints])


def test_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rows = [(i, "the same words again and again", 0, "") for i in range(9)] + [(20, "other words than those above", 0, ""), (None, "the same words again and again", 0, "")]
    got = run(spark, rows[:10])
    assert got == plain_components([(r[0], plain_fingerprint(r[1])) for r in rows[:10]])
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int, fp string")
    assert simhash.near_duplicates(df).where("doc_id is null and component_id = 0").count() == 1


def test_null_row_as_bridge(spark, monkeypatch):
    """A row without an id joins those on its two sides, wherever its fingerprint stands in Gray order."""
    for case, bridge in enumerate((0b000, 0b111000, 0b011, 0b111111)):
        prints = [(5, bridge ^ 0b000111), (None, bridge), (9, bridge ^ 0b111000), (7, 0x7F << 40)]
        df = spark.createDataFrame(prints, "doc_id long, fp long")
        monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: df)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
        assert got == {5: 5, None: 5, 9: 5, 7: 7}, case
