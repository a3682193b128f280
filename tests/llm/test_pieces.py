"""Encoding against the library's own, on every word of a table and odd texts; round trips."""

import numpy as np
import pytest

from tests.conftest import SMALL

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "a ", "a  ", "  a\tb\nc", "Hello  world", "x\n\n  y \n z", "x▁y", "▁", "▁▁ a", "日本語 テキスト", "<s> </s> <unk> <0x41>", "\x00a", "ﬁ Å ​", "🙂🙂 ok",
    "a" * 5000, "    indented\n        more", "antidisestablishmentarianism", "internationalization," * 30,
]


def test_odd_texts_and_whole_table(spark):
    from tracewell.llm.pieces import decode, digest, encode

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], docs.schema)
    rows = decode(encode(docs.union(odd), MODEL), MODEL).collect()
    assert len(rows) == docs.count() + len(ODD)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == sp.encode(r.text or ""), (r.text or "")[:80]
        assert r.decoded == (r.text or "").replace("▁", " ") == sp.decode(sp.encode(r.text or ""))
    assert all(r.round_trip for r in digest(docs.union(odd), MODEL).collect())
    assert digest(docs.limit(0), MODEL).collect() == []


def test_clashing_columns(spark):
    from tracewell.llm.pieces import encode

    df = spark.createDataFrame([("a b", 7, "x", 1)], "text string, ids int, decoded string, doc_id long")
    r = encode(df, MODEL).first()
    assert (r.text, r.decoded, r.doc_id, len(r.ids)) == ("a b", "x", 1, 8)


def test_very_long_words():
    import random
    import tracemalloc

    from tracewell.llm.pieces import Pieces, _encoder

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces, rng = Pieces(MODEL), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDE0123456789+/=éß日本語の文章🙂"
    for n in (20_000, 1_000_000):
        word = "".join(rng.choices(letters, k=n))
        tracemalloc.start()
        ids = pieces.encode_words(["▁" + word])["▁" + word]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < (100 << 20) + 250 * n if n > 100_000 else peak < 40 << 20
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(word)
    spaces = ["x" + " " * 200_000 + "y  z", " " * 200_000, "a" * 300 + " " * 1001 + "b" * 300]
    for text, ids in zip(spaces, _encoder(MODEL)(spaces), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)


def test_heap_merges_like_scans():
    import random

    from tracewell.llm import pieces as module

    pieces, rng = module.Pieces(MODEL), random.Random(4)
    for _ in range(2000):
        word = "".join(rng.choices(["▁", "▁▁▁", "the", "in", "e", "r", "s", "t", "日", "🙂"], k=rng.randint(1, 9)))
        if len(word) <= module.HEAP_CHARS:
            assert pieces.merged_by_heap(word) == pieces.merged(word), word
