"""The pipeline's stages against brute force, each on what the stage before it kept."""

from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_passages

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def test_stages(spark):
    import corpus_pipeline as c
    from tracewell.llm.quality_classifier import scored
    from tracewell.llm.shared import materialize

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = []
    for _, stage in c.STAGES:
        docs = materialize(stage(spark, docs, SMALL), "test-stage")
        kept.append(docs)
    first, second, third, fourth, last = kept
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert all(d.columns == whole.columns for d in kept[:4])
    good = {r.doc_id for r in scored(whole, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in first.collect()} == good
    groups = brute_groups([(r.doc_id, r.text) for r in first.collect()])
    assert sorted(r.doc_id for r in second.collect()) == sorted(d for d, _, c_ in groups if d == c_)
    want = {r[0]: r for r in brute_passages([(r.doc_id, r.text) for r in second.collect()])}
    cut = {r.doc_id: r for r in third.collect()}
    assert cut.keys() == want.keys() and all(r.n_chars == len(r.text) for r in cut.values())
    assert all(r.text == s.text for s in second.collect() for r in [cut[s.doc_id]] if want[s.doc_id][2] == 0)
    times = Counter(r.doc_id for r in fourth.collect())
    assert set(times) <= set(cut) and max(times.values()) <= 2
    assert all(r.text == cut[r.doc_id].text for r in fourth.collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = sorted(last.collect(), key=lambda r: r.position)
    from tracewell.llm.mixing import mix

    turns = sorted((p, r.doc_id) for r in mix(third).collect() for p in r.positions)
    assert [r.doc_id for r in rows] == [d for _, d in turns]
    assert Counter(r.doc_id for r in rows) == times
    assert all(np.frombuffer(r.ids, "<u4").tolist() == sp.encode(cut[r.doc_id].text) for r in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in c.run(spark, SMALL).collect()) == Counter((r.doc_id, r.n_tokens) for r in rows)


def test_no_documents(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.collect() == []


SAME = "one two three four five six seven eight nine ten eleven twelve"


def test_rows_without_unique_ids(spark):
    import corpus_pipeline as c

    rows = [(1, SAME, 5), (1, "a completely other text with words enough for shingles", 6), (None, SAME + " ", 7), (None, "yet another text that nobody else has at all", 8), (None, None, 9), (3, SAME, 1), (3, SAME, 1)]
    docs = spark.createDataFrame([(i, t, "en", "s" if k % 2 else None, k, k, k, k) for k, (i, t, _) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, taken int, position int, row_key int")
    kept = c.one_of_each_group(spark, docs, SMALL)
    assert kept.columns == docs.columns and sorted(r.taken for r in kept.collect()) == [0, 1, 3, 4]
    late = docs.withColumn("doc_id", docs["doc_id"] * -1)
    assert sorted(r.taken for r in c.one_of_each_group(spark, late, SMALL).collect())[-1] in (5, 6)
    mixed = c.mixed_sources(spark, docs, SMALL)
    times = Counter(r.taken for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= set(range(7)) and max(times.values()) <= 2
    cut = c.no_repeated_passages(spark, docs, SMALL)
    assert cut.columns == docs.columns and sorted(r.taken for r in cut.collect()) == list(range(7))


def test_rejected_rows_go_one_by_one(spark):
    import corpus_pipeline as c
    from tracewell.llm.quality_classifier import scored

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    score = {r.doc_id: r.predicted for r in scored(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    good, bad = (next(d for d in sorted(score) if score[d] == k) for k in (1, 0))
    pair = docs.where(docs["doc_id"].isin(good, bad))
    nameless = pair.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    kept = c.good_documents(spark, docs.unionByName(nameless), SMALL).where("doc_id is null").collect()
    text = {r.doc_id: r.text for r in pair.collect()}
    assert [r.text for r in kept] == [text[good]]
