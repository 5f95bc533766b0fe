import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece

from rankloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "\n", " \n x", "é😀一 ▁x", "▁", "x ▁ y", "tab\tq", "0123 45", "ﬁ ½ Ａ　b é", "x" * 5000, "\0 a\0"]


def library(text, lib):
    proto = lib.encode(text, return_type="proto")
    return [p.id for p in proto.pieces], [p.begin for p in proto.pieces], [p.end for p in proto.pieces], text.encode()


def check(codec, lib, texts):
    ids, starts, ends, bounds = codec.encode(texts)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        want = library(t, lib)
        n = len(want[3])
        assert ids[a:b].tolist() == [*want[0], lib.eos_id()], t
        assert starts[a:b].tolist() == [*want[1], n], t
        assert ends[a:b].tolist() == [*want[2], n], t


def texts():
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rng = random.Random(2)
    mixed = ["".join(rng.choices([" ", "  ", "a", "the", "é", "😀", "\n", "ß", "Z", "9"], k=rng.randint(1, 40))) for _ in range(300)]
    return ODD + mixed + [t or "" for t in docs]


def test_word_by_word_equals_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    codec = pieces.Codec(open(PATH, "rb").read())
    assert codec.by_word
    for _ in range(2):
        check(codec, lib, [t for t in texts() if pieces.SPACE not in t])
    check(codec, lib, texts())


def test_character_map_equals_library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        for trim in (True, False):
            for dummy in (True, False):
                model = pb.ModelProto.FromString(open(PATH, "rb").read())
                spec = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec
                model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
                model.normalizer_spec.remove_extra_whitespaces = trim
                model.normalizer_spec.add_dummy_prefix = dummy
                blob = model.SerializeToString()
                codec = pieces.Codec(blob)
                assert rule == "identity" or not codec.by_word
                check(codec, sentencepiece.SentencePieceProcessor(model_proto=blob), texts()[:150])


def test_frames(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, None, None), (3, None, None), (1, "long word " * 40_000, "y")]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert len(got) == len(rows)
    for row, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id, len(r.ids), r.ids)), sorted(rows, key=lambda r: (r[0], len(lib.encode(r[1] or "")), lib.encode(r[1] or "")))):
        ids = [*lib.encode(t or ""), lib.eos_id()]
        assert (row.doc_id, row.ids, row.decoded) == (i, ids, lib.decode(ids))
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query_and_spans(spark, sf_dir):
    """The query against the library, and slices of the source at the spans against the pieces."""
    from rankloom.llm.queries import QUERIES

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = {r.doc_id: r for r in QUERIES["op5_sentencepiece"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        ids, _, ends, source = library(text, lib)
        ids, r = [*ids, lib.eos_id()], got[d]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
        assert (r.n_source_bytes, r.ends_sha256) == (len(source), sha(" ".join(map(str, [*ends, len(source)]))))
    for r in pieces.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH).collect():
        source = docs[r.doc_id].encode()
        cut = [source[a:b] for a, b in zip(r.starts, r.ends)]
        assert b"".join(cut) == source
        for i, own in zip(r.ids, cut):
            if not lib.is_byte(i) and not lib.is_control(i):
                assert own.decode() in (lib.id_to_piece(i).replace("▁", " "), lib.id_to_piece(i).replace("▁", " ")[1:])


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "_KEPT", 1 << 18)
    codec = pieces.Codec(open(PATH, "rb").read())
    for k in range(20):
        codec.encode([chr(0x4E00 + k) * 100_000])
        assert codec.kept < (1 << 18) + 200_000 and sum(map(len, codec.word)) < (1 << 18) + 200_000
