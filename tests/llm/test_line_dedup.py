"""Frequent lines against brute force, whatever the batches; runs and their levels; the shuffled pass; edge cases."""

import hashlib
import random

import pytest

from tracewell.llm import line_dedup as lines
from tracewell.llm import shared


def key_of(line):
    line = line.strip(" \t\n\v\f\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute(docs):
    seen = {}
    for _, text in docs:
        for k in {key_of(x) for x in (text or "").split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, text in docs:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if seen.get(key_of(x), 0) < 10]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def documents(rng, n):
    common = [f"Common line {k}" for k in range(40)]
    docs = []
    for i in range(n):
        own = [f"line {i} {k}" for k in range(rng.randrange(4))]
        picked = [rng.choice((" ", "\t", "", " ")) + (c.upper() if rng.random() < 0.3 else c) + rng.choice(("", "\r", " ")) for c in rng.sample(common, rng.randrange(6))]
        text = own + picked + picked[:1] + [""] * rng.randrange(3)
        rng.shuffle(text)
        docs.append((rng.choice((None, i, i, 7)), "\n".join(text)))
    return docs + [(1, None), (None, None), (2, ""), (3, "\n\n"), (4, "Common line 1\n" * 500), (5, "ÀÉ\nàé")]


def table(spark, docs):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, n_lines string, hash int")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(shared, "BROADCAST_LIMIT_BYTES", limit)
    docs = documents(random.Random(8), 200)
    table(spark, docs).repartition(11).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    assert len(lines.batches_of(stored)) == lines.BATCHES
    assert sorted((tuple(r) for r in lines.digest(stored).collect()), key=str) == brute(docs)
    assert sorted((tuple(r) for r in lines.digest(table(spark, docs)).collect()), key=str) == brute(docs)


def test_other_columns_stay(spark):
    docs = [(k, "shared\nown " + str(k)) for k in range(10)] + [(11, None)]
    got = lines.without_frequent_lines(table(spark, docs))
    assert got.columns == ["doc_id", "text", "n_lines", "hash", "n_lines_1", "n_dropped"]
    assert {tuple(r) for r in got.collect()} == {(k, f"own {k}", "x", 5, 2, 1) for k in range(10)} | {(11, None, "x", 5, 1, 0)}


def test_empty_table(spark):
    assert lines.digest(table(spark, [])).collect() == []


def test_levels(spark):
    runs = lines.Runs(spark, 10, buckets=3)
    make = lambda k: spark.range(k, k + 50).selectExpr("unhex(md5(string(id))) AS hash", "4L AS n")
    for k in range(7):
        runs.add(make(10 * k))
        assert [bool(x) for x in runs.levels] == [bool(k + 1 >> b & 1) for b in range((k + 1).bit_length())]
    seen = {}
    for k in range(7):
        for i in range(10 * k, 10 * k + 50):
            seen[i] = seen.get(i, 0) + 4
    plan = runs._merged(runs.levels[1], runs.levels[2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    known = spark.table(runs.levels[2]).select("hash").hint("merge")
    plan = make(5).join(known, "hash", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, "only the batch is shuffled"
    want = {hashlib.md5(str(i).encode()).digest() for i, n in seen.items() if n >= 10}
    assert {bytes(r.hash) for r in runs.frequent().collect()} == want and [bool(x) for x in runs.levels] == [False, False, True]
    runs.close()
    assert runs.frequent().count() == 0


def test_hashes_that_agree_in_their_upper_half(spark):
    hashes = [b"A" * 8 + bytes([k]) * 8 for k in range(5)] + [hashlib.md5(b"line").digest()]
    frequent = spark.createDataFrame([(h,) for h in hashes], "hash binary")
    got = lines.without(spark.createDataFrame([("line\nother",)], "text string"), frequent, "text string, a long, b long", "a", "b")
    assert [tuple(r) for r in got.collect()] == [("other", 2, 1)]
