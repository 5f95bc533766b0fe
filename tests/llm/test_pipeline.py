import hashlib
import random

import brute
import public_tokenizers
import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def by_hand(spark, docs, sf_dir):
    """Rows (doc_id, n_tokens, ids, hash of what they decode to) of all stages in plain Python."""
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    rows = [r for r, keep in zip(rows, brute.kept(rows, labels)) if keep]
    first = brute.first_of_groups([(d, t) for d, _, t in rows])
    rows = [(d, t) for i, (d, _, t) in enumerate(rows) if i in first]
    rows = [(d, t) for d, t in rows if not brute.contamination(t, items)[4]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    out = []
    for d, t in rows:
        ids = library.encode(brute.redacted(t or ""), add_eos=True)
        out.append((d, len(ids), ids, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out)


def test_run_equals_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = by_hand(spark, docs, sf_dir)
    got = sorted((r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert got == want
    assert 0 < len(got) < docs.count()


def test_duplicates_go_row_by_row(spark, sf_dir):
    rng = random.Random(0)
    a, b, c = (" ".join(rng.choice("one two three four five six seven eight nine ten".split()) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(3))
    rows = [(3, b), (5, a), (5, b), (5, a), (None, b), (7, a), (8, c), (8, c), (9, c), (4, None), (6, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    stay = brute.first_of_groups(rows)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).collect()), key=str)
    assert got == sorted((rows[i] for i in stay), key=str) == sorted([(3, b), (5, a), (8, c), (None, b), (4, None), (None, None)], key=str)


def test_stages_take_nulls_repeats_and_no_rows(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, None, "en", "web", 0), (900001, None, "en", "web", 0), (900002, "", None, None, None), (None, "token=abcdef123", "en", None, 15)], base.schema)
    for docs in (base.limit(0), odd):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, sf_dir)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
                now = spark.createDataFrame([tuple(r) for r in after.collect()], docs.schema)
            else:
                assert after.count() == now.count()
        assert docs is not odd or now.where("text = '[SECRET]'").count() == 1
