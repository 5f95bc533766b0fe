import random

import brute
from rankloom.llm.decontaminate import contamination

SCHEMA = "doc_id long, text string, words string, n string, item_id string, prints string"


def check(spark, docs, items):
    df = spark.createDataFrame([(d, t, "x", "y", "z", "w") for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, "other") for i, t in items], "item_id string, text string, doc_id string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(df, bench).collect()), key=str)
    assert got == sorted(((d, *brute.contamination(t, items)) for d, t in docs), key=str)
    return got


def test_random_texts_of_few_words(spark):
    rng = random.Random(3)

    def prose(n, kinds=40):
        return " ".join(rng.choice(["a", "Bc", "dé", "È", "x9", "mm", "zz"]) + str(rng.randrange(kinds // 7)) for _ in range(n))

    items = [(f"i{k}", prose(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for k in range(25)]
    docs = []
    for k in range(80):
        text = prose(rng.choice([0, 1, 5, 13, 40, 300]))
        if k % 3 == 0:
            whole = brute.words(rng.choice(items)[1])
            begin = rng.randrange(len(whole))
            text += " ... " + ", ".join(whole[begin:begin + rng.choice([5, 12, 13, 20])]).upper() + " " + prose(20)
        docs.append((k, text))
    got = check(spark, docs, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "... !!"), (4, passage), (4, passage), (4, "other text"), (None, passage), (5, passage.replace(" ", "\n")), (6, "x " * 100_000 + passage), (7, "x " * 500 + passage)]
    check(spark, docs, [("b", passage), ("a", passage), (None, "other text"), ("c", ""), ("d", None)])
    check(spark, docs, [("a", "Other")])
    check(spark, docs, [])
    check(spark, [], [("a", passage)])
