import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankloom.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def spelt(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def plain(texts, sides):
    """One row for each text, token by token."""
    a, b = sides
    level = alignment._bytes_of_levels()
    every, total = [], Counter()
    for text in texts:
        links, groups, ids = [], [], ([], [])
        if text:
            own = (" " + text).encode()
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spans = []
            for side, spell in ((0, lambda i: bytes(level[c] for c in a.id_to_token(i))), (1, lambda i: spelt(b.id_to_piece(i)))):
                at, out = 0, []
                for i in ids[side]:
                    out.append((at, at + len(spell(i)), i))
                    at += len(spell(i))
                spans.append(out)
            joined = [b"".join(bytes(level[c] for c in a.id_to_token(i)) for i in ids[0]), b"".join(spelt(b.id_to_piece(i)) for i in ids[1])]
            if joined != [own, own]:
                ids = ([], [])
            else:
                j = 0
                for s, e, x in spans[0]:
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(spans[1]) and spans[1][k][0] < e:
                        links.append((x, spans[1][k][2]))
                        k += 1
                cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                by = [defaultdict(list), defaultdict(list)]
                for side in (0, 1):
                    for _, e, i in spans[side]:
                        by[side][cuts[bisect_left(cuts, e)]].append(str(i))
                groups = [f"{','.join(by[0][c])}|{','.join(by[1][c])}" for c in cuts]
        total.update(links)
        every.append((len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return [(na, nb, ng, len(links), sum(total[l] == best[l[1]] for l in links), sum(total[l] for l in links), g) for na, nb, ng, links, g in every]


CASES = ["The quick brown fox.", "", None, "café naïve 漢字 \U0001f600\U0001f600", " two  spaces ", "▁ own", "tab\tand\nline", "<|endoftext|> <s> </s> <unk> <0x41>", "a", " ", "x" * 3000, "\u0000 nul", "word " * 2000, "don't we'll"]


def test_cases_in_bundles(spark, sides):
    texts = CASES + CASES[:4]
    df = spark.createDataFrame([(None if i == 3 else i % 15, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, bundle string, n_a int")
    want = Counter((None if i == 3 else i % 15, *r) for i, r in enumerate(plain(texts, sides)))
    for size in (alignment.BUNDLE, 40):
        assert Counter(tuple(r) for r in alignment.align(df, FIRST, SECOND, bundle=size).collect()) == want
    assert alignment.align(df.limit(0), FIRST, SECOND).collect() == []


def test_words_are_encoded_as_their_texts_are(sides):
    own = alignment.Pair(open(FIRST, "rb").read(), open(SECOND, "rb").read())
    assert own.by_word
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab1.,'' \n\té漢s\x1c\u00a0\u3000"), 400)) for _ in range(60)] + ["y" * 500, "it's " * 100, "a  b   c " * 60, " x", "x "]
    for text in texts:
        a, b, good = own.ids(own.words(text))
        assert sum(a, []) == sides[0].encode(" " + text, add_special_tokens=False).ids and sum(b, []) == sides[1].encode(text)


def test_query(spark, sf_dir, sides):
    from rankloom.llm.queries import QUERIES

    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    got = QUERIES["op12_alignment"](spark, sf_dir).collect()
    want = Counter((r["doc_id"], *p[:-1], p[-1] and hashlib.sha256(p[-1].encode()).hexdigest()) for r, p in zip(rows, plain([r["text"] for r in rows], sides)))
    assert Counter(tuple(r) for r in got) == want
