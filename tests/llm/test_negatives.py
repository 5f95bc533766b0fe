import math

import numpy as np
import pytest

from rankloom.llm.negatives import BallTree, Search, mine


def plain(rows, anchors, window=(80, 100), scale=256.0, k=5):
    def ok(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])

    def score(a, b):
        return sum(math.floor(scale * x) * math.floor(scale * y) for x, y in zip(a, b))

    out = []
    for i, label, v in {(i, l, tuple(v)) for i, l, v in filter(ok, anchors)}:
        scored = sorted((-score(v, w), j, l) for j, l, w in filter(ok, rows) if j != i)
        for p, pid, _ in [x for x in scored if x[2] == label][:k]:
            hits = [(n, nid) for n, nid, l in scored if l != label and window[0] * -p <= 100 * -n <= window[1] * -p]
            out += [(i, pid, r + 1, nid, -p, -n) for r, (n, nid) in enumerate(hits[:k])]
    return sorted(out)


def run(spark, rows, anchors, **more):
    schema = "vec_id long, label int, vector array<float>"
    v = spark.createDataFrame([(*r, "x", 1) for r in rows], schema + ", key string, scores int")
    return sorted(tuple(r) for r in mine(v, spark.createDataFrame(anchors, schema), **more).collect())


def test_blocks_and_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(4)), [float(x) for x in np.float32(rng.normal(size=5) + 0.7)]) for i in range(400)]
    rows += [(500 + i, 1, [1.0] * 5) for i in range(30)] + [(600 + i, 2, [1.0] * 5) for i in range(30)] + [(700, 3, [0.9] * 5)] * 7  # ties and repeated rows
    rows += [(800, 1, None), (801, 2, [1.0, None]), (802, 1, [float("nan")] * 5), (803, 3, [float("-inf")] * 5), (804, 1, []), (805, 2, [2.0]), (None, 1, [9.0] * 5), (806, None, [1.0] * 5)]
    anchors = [*rows[:30], rows[0], (500, 1, [1.0] * 5), (700, 3, [0.9] * 5), (900, 2, [0.0] * 5), (901, 1, [-1.0] * 5), (902, 9, [1.0] * 5), (903, None, [1.0] * 5), (904, 1, None), (905, 1, [])]
    want = plain(rows, anchors)
    assert len(want) > 300
    assert run(spark, rows, anchors) == want
    assert run(spark, rows, anchors, block=32, leaf=4, per_cell=7, per_group=100) == want
    assert run(spark, rows, anchors, window=(50, 120)) == plain(rows, anchors, (50, 120))
    assert run(spark, [], anchors) == [] and run(spark, rows, []) == []


def test_beyond_exact_doubles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.float32(rng.normal(size=3) * 1e6 + 1e6)]) for i in range(60)]
    assert run(spark, rows, rows[:9], block=16, leaf=4) == plain(rows, rows[:9])
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, 0, [3e30]), (2, 0, [3e30])], [(1, 0, [3e30])])


def test_tree_prunes():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 2000
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 8)) * 20)
    labels, ids = np.repeat(np.arange(40) % 2, 100), rng.permutation(4000)
    tree = BallTree(rows, labels, ids, 64)
    assert sorted(tree.ids) == list(range(4000)) and all(len(set(tree.labels[a:b])) == 1 or b - a > 64 for a, b in zip(tree.start, tree.stop))
    own = np.arange(0, 4000, 50)
    search = Search(rows[own], ids[own], labels[own], np.full((80, 1), -np.inf), np.full((80, 1), np.inf), 5, True)
    search.meet(tree)
    number, _, found, score = search.results()
    for i in range(80):
        want = sorted((-int(rows[own[i]] @ rows[j]), int(ids[j])) for j in range(4000) if labels[j] == labels[own[i]] and ids[j] != ids[own[i]])[:5]
        assert sorted((-int(s), int(f)) for s, f in zip(score[number == i], found[number == i])) == want
    assert search.scored < 80 * 4000 / 4
