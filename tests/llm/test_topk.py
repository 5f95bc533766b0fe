import math

import numpy as np
import pytest

from rankloom.llm.topk import threshold_top, top_k


def plain(rows, queries, k, scale=256.0):
    out = []

    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    def whole(v):
        return [math.floor(scale * x) for x in v]

    for q, v in {(q, tuple(v)) for q, v in queries if q is not None and ok(v)}:
        scores = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), i) for i, w in rows if i is not None and ok(w) and i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, queries, **more):
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, vector array<float>, score int")
    q = spark.createDataFrame(queries, "query_id long, vector array<float>")
    return sorted(tuple(r) for r in top_k(v, q, **more).collect())


def test_blocks_and_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(120)]
    rows += [(200 + i, [1.0] * 6) for i in range(40)] + [(7, [0.5] * 6)] * 9  # ties and repeated rows
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (305, [2.0]), (None, [9.0] * 6), (306, [3e30, 1.0])]
    queries = [(0, rows[0][1]), (7, [0.5] * 6), (7, [0.5] * 6), (50, [0.0] * 6), (51, [1.0, 0.0, 0.0, 0.0, 0.0, -1.0]), (52, None), (53, []), (54, [float("nan")]), (None, [1.0] * 6), (55, [1.0] * 6)]
    small = [r for r in rows if r[0] != 306]
    assert run(spark, small, queries) == plain(small, queries, 5)
    assert run(spark, small, queries, k=3, block=16, sent=4) == plain(small, queries, 3)
    assert run(spark, rows[:4], queries) == plain(rows[:4], queries, 5)
    assert run(spark, [], queries) == [] and run(spark, rows, []) == []
    with pytest.raises(Exception, match="64 bits"):
        run(spark, rows, queries)
    large = [(i, [float(x) for x in np.float32(rng.normal(size=3) * 1e6)]) for i in range(50)]  # beyond exact doubles, within 64 bits
    assert run(spark, large, large[:9], block=8) == plain(large, large[:9], 5)


def test_threshold_stops_and_is_exact():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.pareto(1.0, (3000, 3)) * 50)
    ids = rng.permutation(3000)
    q = np.floor(rng.normal(size=(20, 3)) * 100)
    number, found, score = threshold_top(q, np.arange(20), rows, ids, 5)
    for i in range(20):
        want = sorted((-int(s), int(r)) for s, r in zip(rows @ q[i], ids) if r != i)[:5]
        assert [(-int(s), int(r)) for s, r in zip(score[number == i], found[number == i])] == want
