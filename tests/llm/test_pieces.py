"""Encoding against the model's own library, and exact round trips."""

import random

import pyarrow as pa
import sentencepiece

from arcweft.llm import pieces
from arcweft.llm.words import slices

ODD = ["", " ", "  ", "   hello   world  ", "\n", "a\n\n b\tc\r\n", "é à ß ñ", "日本語 テスト", "\U0001d6fc ½ ﬁ  x", "<s> </s> <unk> <0x0A>", "x" * 500, " " * 200, "ab " * 300 + "y" * 90, "▁under", "THE!! QUICK%%% 12345 67.89", "don't", "é", "\U0001f600" * 80, "日本語のテスト文章です。" * 30, "ab" * 100 + "ба" * 90 + "x1" * 70, *("".join(p[i.bit_count() & 1] for i in range(2048)) for p in ("ab", "ba")), "a" + " " * 70 + "b", "\n" + "q" * 80]


def test_ids_equal_the_library_s(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(7)
    letters = "aeiou bcdt\n.,ERéß0159  #$"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts = [t for t in texts if "▁" not in t]  # the library cannot tell this sign from a space
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    model = pieces.Model(pieces.model_bytes(pieces.MODEL))
    for limit in (1 << 21, 1000):
        got = []
        for s in slices(pa.array(texts), limit):
            ids, bounds = pieces.encode_texts(model, s)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        for t, ids in zip(texts, got):
            assert ids == sp.encode(t), repr(t[:80])


def test_round_trip_and_edge_cases(spark):
    rows = [(i, t, "k") for i, t in enumerate([*ODD, None, "z" * 100_000, "w " * 100_000])] + [(None, "a b", "k"), (None, "a b", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = pieces.decode(pieces.encode(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == r.text
        assert (r.ids is None) == (r.text is None) and (r.text != "" or r.ids == [])
    assert all(r.decoded_equal for r in pieces.op6_sentencepiece(docs).collect())
    assert pieces.op6_sentencepiece(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([([3 + 0xFF, 5],), ([],), (None,)], "ids array<int>")
    assert [r.decoded is None for r in pieces.decode(bad).collect()] == [False, False, True]
