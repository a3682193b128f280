"""Removed passages against brute force over all windows, and edge cases."""

import hashlib
import random
from collections import Counter

from tests.conftest import SMALL


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_all_documents(spark):
    from tracewell.llm.suffix_dedup import digest

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in digest(docs.repartition(7)).collect()) == brute(rows)


def test_planted_cases(spark):
    from tracewell.llm import suffix_dedup

    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passage = text(400)
    rows = [(i, text(50 + 31 * i) + passage[: 150 + 9 * i] + text(97)) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "a" * 199), (103, "a" * 1000), (104, "xyz" * 300), (105, "xyz" * 70), (106, passage), (106, passage), (107, passage[:200]), (108, text(201) * 2)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, key int, first string")
    assert sorted(tuple(x) for x in suffix_dedup.digest(docs.repartition(5)).collect()) == brute(rows)
    kept = {x.doc_id: x for x in suffix_dedup.without_repeats(docs).collect()}
    assert kept[106].text == "" and kept[100].text is None and kept[102].text == "a" * 199 and kept[0].first == "k"


def test_long_text_in_pieces(monkeypatch):
    import numpy as np

    from tracewell.llm import suffix_dedup as s

    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=30_000)) * 2, np.uint8)
    whole = s.phrases(data, np.array([0, len(data)]))
    monkeypatch.setattr(s, "PIECE", 7_000)
    cut = s.parse_batch(data, np.array([0, len(data)]))
    starts = lambda x: np.concatenate([np.arange(a, b + 1) for a, b in zip(x[1], x[2])])
    assert (starts(whole) == starts(cut)).all() and len(starts(cut)) == len(data) - 199


def test_no_rows(spark):
    from tracewell.llm.suffix_dedup import digest

    assert digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_ranks_follow_byte_order():
    import numpy as np

    from tracewell.llm.suffix_dedup import suffix_ranks

    r = random.Random(5)
    part = bytes(r.choices(b"ab", k=260))
    blob = b"".join([bytes(r.choices(b"ab", k=240)), part, bytes(r.choices(b"\0\xff", k=230)), part[:230], b"z" * 203, b"z" * 201])
    starts = np.arange(len(blob) - 199)
    found = suffix_ranks(np.frombuffer(blob, np.uint8), starts)
    seen = Counter(blob[i : i + 200] for i in starts)
    assert [x > 0 for x in found] == [seen[blob[i : i + 200]] > 1 for i in starts]
    some = [i for i in starts if found[i]]
    assert all((found[i] < found[j]) == (blob[i : i + 200] < blob[j : j + 200]) for i in some for j in some)
    few = np.array([0, 240, 245])  # other starts don't count
    assert suffix_ranks(np.frombuffer(blob, np.uint8), few).tolist() == [0, 0, 0]


def test_a_passage_that_many_documents_share(spark, monkeypatch):
    from tracewell.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT_PHRASES", 5)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = text(300), text(230)
    rows = [(i, text(220 + i % 50) + passage[i % 9 :] + text(210) + (other if i % 7 == 0 else "")) for i in range(60)]
    rows += [(100, rows[3][1]), (101, passage), (101, passage), (None, rows[4][1]), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, text_marks int, _key int").repartition(4)
    key = lambda x: (x[0] is None, x)
    got = sorted((tuple(x) for x in suffix_dedup.digest(docs).collect()), key=key)
    want = [(d if d >= 0 else None, *rest) for d, *rest in brute([(-1 if d is None else d, t) for d, t in rows])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_suffixes_are_sorted_a_few_triggers_at_a_time(spark, monkeypatch):
    import tracemalloc

    import numpy as np

    from tracewell.llm import suffix_dedup as s

    r = np.random.default_rng(4)
    trigger, size = r.integers(0, 9_000, 40_000), r.integers(200, 361, 40_000)
    groups = list(s.whole_triggers(trigger, size))
    assert sorted(np.concatenate(groups).tolist()) == list(range(40_000)) and list(s.whole_triggers(trigger[:0], size[:0])) == []
    assert sum(len(set(trigger[g].tolist())) for g in groups) == len(set(trigger.tolist()))  # no trigger is in two
    assert max(size[g].sum() for g in groups) < s.COMPARED_BYTES + 20 * 361
    blob = r.integers(97, 99, int(max(size[g].sum() for g in groups)), dtype=np.uint8)
    tracemalloc.start()
    s.suffix_ranks(blob, np.arange(0, len(blob) - 200, 3))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    monkeypatch.setattr(s, "COMPARED_BYTES", 1)
    text = "".join(random.Random(8).choices("abcdefgh ", k=700))
    rows = [(i, f"{i:09d}" * 4 + text[7 * i :] + f"{i:09d}" * 30) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in s.digest(docs).collect()) == brute(rows)


def test_workers_give_memory_back_after_a_task(monkeypatch):
    from types import SimpleNamespace

    from tracewell.llm import textbytes as tb

    said = []
    monkeypatch.setattr(tb.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: said.append("released")))
    double = tb.released(lambda batches: (said.append(b) or 2 * b for b in batches))
    assert list(double(iter([1, 2]))) == [2, 4] and said == [1, 2, "released"]
