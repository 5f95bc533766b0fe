import math

import brute
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from rankloom.llm import quality

ROWS = [(1, "en", "the cat sat on the mat"), (2, "en", "the dog sat on the log, twice"), (3, "es", "el gato duerme"), (4, None, "no language at all"), (5, "en", ""), (6, "en", None), (None, "en", "the unknown"), (7, "xx", "the cat"), (8, "en", "ZZQ %%% 0x1f 😀 zzqq"), (8, "en", "ZZQ %%% 0x1f 😀 zzqq"), (9, "en", "the cat sat " * 2000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, lang string, text string, gram string, n long")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def scores(spark, model, rows, **more):
    """nll by (doc_id, characters)."""
    return {(r.doc_id, r.n): r.nll for r in quality.Classifier(model, **more).score(frame(spark, rows)).collect()}


@pytest.mark.parametrize("order", [1, 3, 5])
def test_probabilities(spark, order):
    docs = frame(spark, ROWS)
    model = quality.kneser_ney(docs.where("lang = 'en'"), order)
    plain = brute.Model([t for d, lang, t in ROWS if lang == "en" and t], order)
    want = {(d, len(t or "")): pytest.approx(plain.nll(t or ""), rel=1e-5) for d, _, t in ROWS}
    assert scores(spark, model, ROWS) == want
    assert scores(spark, model, ROWS, bundle=30, per_shard=500) == want  # many bundles and shards
    contexts = {g[:-1] for g in plain.p if len(g) == order}
    for context in list(contexts)[:5]:
        assert sum(plain.prob((*context, s)) for s in range(quality.SYMBOLS)) == pytest.approx(1)


def test_edges(spark):
    docs = frame(spark, ROWS)
    made = quality.train(docs, labels(spark, [(d, 1, 0) for d in range(1, 8)] + [(1, 1, 0), (8, 0, 1)]))
    judged = made.judge(docs).collect()
    assert len(judged) == len(ROWS) and all(math.isfinite(r.perplexity) for r in judged)
    assert all(r.keep for r in judged if r.n_chars_scored == 0)
    whole = made.kept(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.keep for r in judged)
    assert made.kept(docs.limit(0)).isEmpty() and made.judge(docs.limit(0)).isEmpty()
    none = quality.train(docs, labels(spark, [(1, 0, 0)]))
    assert none.kept(docs).count() == len(ROWS) and none.judge(docs).where("keep").count() == len(ROWS)


def test_query_equals_the_plain_version(spark, sf_dir):
    from rankloom.llm.queries import QUERIES

    docs, marked = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "labels"))
    rows = [(r.doc_id, r.lang, r.text) for r in docs]
    want = brute.judged(rows, [(r.doc_id, r.quality, r.toxic) for r in marked])
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (d, lang, _), (n, own, smoothed, most, behind) in zip(rows, want):
        r = got[d]
        assert (r.lang, r.n_chars_scored, r.n_held_out, r.keep) == (lang or "", n, behind, smoothed <= most)
        assert (r.perplexity, r.smoothed_perplexity, r.threshold) == pytest.approx((own, smoothed, most), rel=1e-5)


def test_held_out_accuracy(spark):
    """Trained on half of the labels: the other half's good texts stay and its bad ones mostly go.

    On sf0.1: of sf0.01's labels some 40 would be left to set all thresholds.
    """
    docs, marked = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    made = quality.train(docs, marked.where("doc_id % 2 = 0"))
    found = made.judge(docs).join(marked.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.keep for r in found if r.quality == 1 and r.toxic == 0]
    bad = [r.keep for r in found if r.quality == 0]
    toxic = [r.keep for r in found if r.toxic == 1]
    print(f"kept {sum(good)} of {len(good)} good, {sum(bad)} of {len(bad)} bad, {sum(toxic)} of {len(toxic)} toxic")
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_model_tells_code_points_apart_and_grows(spark):
    """Russian prose against the same text with every letter moved by 7: folded by 7 they were one text."""
    prose = "мама мыла раму, а папа читал газету у окна. "
    moved = "".join(chr(ord(c) + 7) if c > "\x7f" else c for c in prose)
    model = quality.kneser_ney(frame(spark, [(1, "ru", prose * 20)]))
    nll = scores(spark, model, [(1, "ru", prose), (2, "ru", moved)])
    assert nll[2, len(moved)] > 3 * nll[1, len(prose)]
    many = frame(spark, [(1, "zh", "".join(chr(0x4E00 + i) for i in range(5000)))])
    assert quality.gram_counts(many).where("lang = 'zh'").count() == 5000


def test_toxic_documents_are_not_trusted(spark):
    clean, toxic = "the cat sat on the mat with the dog. ", "you worthless trash, you idiot scum. "
    docs = frame(spark, [(d, "en", (clean if d % 2 else toxic) * 10) for d in range(1, 101)])
    made = quality.train(docs, labels(spark, [(d, 1, 1 - d % 2) for d in range(1, 101)] + [(d, 1, 0) for d in (2, 4)]))
    judged = {r.doc_id: r.keep for r in made.judge(docs).collect()}
    assert all(judged[d] for d in range(1, 101, 2)) and not any(judged[d] for d in range(2, 101, 2))


def test_repeats_stay_apart(spark):
    """Repeated rows, ids and null ids with a good and a bad text: the same rows whatever the bundles and shards."""
    good, junk = "the cat sat on the mat. ", "ZZQ %%% 0x1f zzqq "
    rows = [(d, "en", good * (1 + d % 9)) for d in range(1, 61)]
    rows += rows[:30] + [(200, "en", good), (200, "en", junk * 9), (None, "en", good), (None, None, junk * 9), (None, "en", junk * 9), (None, "en", good), (201, "en", None), (202, "*", junk * 9)]
    docs, marked = frame(spark, rows), labels(spark, [(d, 1, 0) for d in range(1, 61)])
    here, spread = quality.train(docs, marked), quality.train(docs, marked, bundle=1, per_shard=100)
    assert {k: pytest.approx(v) for k, v in here.limits.items()} == spread.limits

    def judged(made):
        return sorted((r.doc_id or 0, r.n_chars_scored, round(r.perplexity, 5), r.keep) for r in made.judge(docs).collect())

    def kept(made):
        return sorted((r.doc_id or 0, r.text or "") for r in made.kept(docs).collect())

    assert judged(spread) == judged(here) and len(judged(here)) == len(rows)
    assert kept(spread) == kept(here) and not any(t.startswith(junk) for _, t in kept(spread))


def test_numbers_survive_packing():
    import numpy as np

    a, b = np.array([0, 1, 1 << 41], np.int64), np.array([5, (1 << 63) - 1, 0], np.int64)
    assert [x.tolist() for x in quality._unpacked(quality._packed(a, b), 3)] == [a.tolist(), b.tolist()]
    places = quality._Pairs(a, b)
    assert places.find(a, b).tolist() == [0, 1, 2] and places.find(b, a).tolist() == [-1] * 3
    assert pa.array(quality._distinct(a, b)[2]).to_pylist() == [0, 1, 2]


def test_shards_are_even(spark):
    """Over 1,024 shards none holds twice the median, and every n-gram is where it is looked for."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("lang", "text")
    model = quality.kneser_ney(docs)
    counts = model.counts.withColumn("slots", quality._slots_of(1, 1024))
    held = np.array([r["count"] for r in counts.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect()])
    assert len(held) == 1024 and held.max() < 2 * np.median(held)
    some = model.counts.where("lang = 'de'").withColumn("slots", quality._slots_of(4, 1024)).sample(0.01, 1).collect()
    assert {r["size"] for r in some} == {2, 3, 4, 5}
    for r in some:
        want = {int(quality._slot("de", r["size"], np.array([r.high]), np.array([r.gram]), copy, 1024)[0]) for copy in range(4 if r["size"] <= quality.SHORT else 1)}
        assert set(r.slots) == want and len(r.slots) == len(want)


def test_short_grams_lie_in_several_shards(spark, monkeypatch):
    docs = frame(spark, ROWS)
    model = quality.kneser_ney(docs)
    want = scores(spark, model, ROWS)
    monkeypatch.setattr(quality, "SHARDS_PER_COPY", 2)
    assert scores(spark, model, ROWS, bundle=30, per_shard=500) == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}


def test_batch_limits_change_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id").withColumn("wide", F.repeat("text", 3))
    docs.write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    made = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), bundle=20_000)
    got = []
    for size, many in ((1 << 26, 10_000), (50_000, 10_000), (1 << 26, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", many)
        try:
            got.append(sorted((r.doc_id, r.keep, round(r.perplexity, 9)) for r in made.judge(docs).collect()))
            assert made.kept(docs).count() == sum(keep for _, keep, _ in got[-1])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2]
