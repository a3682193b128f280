"""The coder's round trip, and files against plain encoding."""

import zlib

import numpy as np
import pytest

from tests.conftest import SMALL

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
MODEL = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5_000, 140_000])
def test_round_trip(n):
    from tracewell.llm.token_files import compress, decompress

    r = np.random.default_rng(n)
    for ids in (r.integers(0, 49_408, n), np.minimum(r.zipf(1.3, n), 40_000), np.arange(n) % 7, np.full(n, 49_407)):
        assert (decompress(compress(ids.astype(np.int64)), n) == ids).all()


def test_repetition_is_cheap():
    from tracewell.llm.token_files import compress

    r = np.random.default_rng(0)
    phrase = r.integers(0, 49_000, 300)
    assert len(compress(np.tile(phrase, 400).astype(np.int64))) < 400 * 300 * 2 / 3


def test_files(spark):
    from tracewell.llm.token_files import digest

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = ["", None, "  ", "Don't  STOP\t\nnow's", "é é 日本 <|endoftext|>x", "a b\x0b\x85c", "ab " * 40_000]
    docs = docs.union(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], docs.schema))
    model = tokenizers.Tokenizer.from_file(MODEL)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want, start = set(), 0
    for doc_id, text in rows:
        ids = [*model.encode(text, add_special_tokens=False).ids, 1]
        want.add((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in digest(docs.repartition(5), MODEL).collect()} == want
    assert digest(docs.limit(0), MODEL).collect() == []


def test_a_damaged_block_is_refused(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracewell.llm.token_files import read_token_files, write_token_files

    docs = spark.createDataFrame([(1, "one two three"), (1, "again"), (None, "x")], "doc_id long, text string")
    write_token_files(docs, str(tmp_path / "f"), MODEL)
    files = spark.read.parquet(str(tmp_path / "f"))
    assert sorted(r.n_tokens for r in read_token_files(files).collect()) == [2, 2, 4]
    with pytest.raises(Exception, match="checksum"):
        read_token_files(files.withColumn("crc32", F.col("crc32") + 1)).collect()


def plain_ids(texts):
    """Each text's ids by the library."""
    model = tokenizers.Tokenizer.from_file(MODEL)
    return [np.array(e.ids, "<u4") for e in model.encode_batch(texts, add_special_tokens=False)]


def encoded(encoder, texts):
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, ends = encoder.encode(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    return np.split(ids, ends[:-1])


def test_texts_equal_the_library(monkeypatch):
    from tracewell.llm import word_bpe

    r = np.random.default_rng(3)
    letters = list("abcdeinrstABCÉÀÖØÞàéöøþÿßµªº×÷ñ0129.,!?'#*<|>-_日本ǅİſʼń \n \n\t\x0b\x7f\0")
    texts = ["".join(r.choice(letters, int(n))) for n in r.integers(0, 24, 6_000)]
    long = word_bpe.LONGEST
    texts += ["don't", "'s", "x'll", "it's.", "<|endoftext|>", "a<|startoftext|>b", "<|x", "a" * long, "a" * (long + 1), "ab" * 3_000, "!" * 200, "1" * 70, "ÀÉ" * 40, "́a", "", " ", "é", "Ã", "a<", "|b", "x" * 16, "x" * 17, "x" * 8, ""]
    encoder = word_bpe.TextEncoder(MODEL)
    for _ in range(2):
        for a, b in zip(encoded(encoder, texts), plain_ids(texts), strict=True):
            assert a.tolist() == b.tolist()
    monkeypatch.setattr(word_bpe, "MOST_ENTRIES", 300)
    monkeypatch.setattr(word_bpe, "MOST_LONG", 3)
    encoder = word_bpe.TextEncoder(MODEL)
    for lo in range(0, len(texts), 40):
        for a, b in zip(encoded(encoder, texts[lo : lo + 40]), plain_ids(texts[lo : lo + 40]), strict=True):
            assert a.tolist() == b.tolist()
    other = word_bpe.TextEncoder(P.path("byte_bpe_50k.json"))
    assert not other.bpe.known


def test_real_ids_take_less_than_their_order_0_entropy():
    import pyarrow.parquet as pq

    from tests.conftest import MEDIUM
    from tracewell.llm.textbytes import buffers
    from tracewell.llm.token_files import compress
    from tracewell.llm.word_bpe import TextEncoder

    texts = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["text"]).column(0).combine_chunks()
    ids, ends = TextEncoder(MODEL).encode(*buffers(texts))
    assert ids.tolist() == np.concatenate(plain_ids(texts.to_pylist())).tolist() and ends[-1] == len(ids)
    times = np.bincount(ids)
    share = times[times > 0] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    bits = 8 * len(compress(ids)) / len(ids)
    print(f"{len(ids)} ids, {bits:.2f} bits each, order-0 entropy {entropy:.2f}")
    assert bits < entropy - 0.3


def test_ids_beyond_the_format_are_refused():
    from tracewell.llm.token_files import MOST_IDS, compress, decompress

    top = np.array([MOST_IDS - 1, 0, 5], np.int64)
    assert (decompress(compress(top), 3) == top).all()
    for bad in (MOST_IDS, -1):
        with pytest.raises(ValueError):
            compress(np.array([bad], np.int64))
