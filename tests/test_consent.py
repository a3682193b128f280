"""Settings files against hand-written cases and a plain reading, and texts cut by bytes against Python."""

import random

from pyspark.sql import functions as F

from tracewell.functions.consent import CATEGORIES, TIERS, granted, settings
from tracewell.functions.text import CUT, cut_bytes

FILES = {
    "empty": (["", None, "# tier = full"], ("hashes_only", {}, [], False, False)),
    "plain": ([" tier = full ", "repo.aa.tier=code", "category.tool_calls = ON", "declined = yes", "x = y", "nothing"], ("full", {"aa": "code"}, ["tool_calls"], True, False)),
    "later": (["category.code_diffs = 1", "category.code_diffs = true", "category.tool_calls = off", "declined = yes", "declined = no"], ("hashes_only", {}, ["code_diffs"], False, False)),
    "twice": (["tier = code", "declined = yes", "tier = code", "declined = no"], ("hashes_only", {}, [], True, True)),
    "spelling": (["tier = Full"], ("hashes_only", {}, [], False, True)),
    "repository": (["tier = full", "repo.aa.tier = code", "repo.aa.tier = code", "repo.bb.tier = full", "repo.aa.tier = full"], ("hashes_only", {}, [], False, True)),
    "nameless": (["repo..tier = code"], ("hashes_only", {}, [], False, True)),
    "odd name": (["repo.tier = code", "repo.a.b.tier = full"], ("hashes_only", {"tier": "code", "a.b": "full"}, [], False, False)),
    "category": (["category.emails = yes"], ("hashes_only", {}, [], False, True)),
    "answer": (["declined = maybe"], ("hashes_only", {}, [], False, True)),
    "changed": (["category.tool_calls = yes", "category.tool_calls = no"], ("hashes_only", {}, [], False, True)),
    "equals": (["tier = full = code"], ("hashes_only", {}, [], False, True)),
}


def test_settings(spark):
    rows = [(owner, k, line) for owner, (lines, _) in FILES.items() for k, line in enumerate(lines)]
    random.Random(4).shuffle(rows)
    lines = spark.createDataFrame(rows, "owner string, k int, line string")
    found = {r["owner"]: (r["tier"], r["repo_tiers"], r["categories"], r["declined"], r["malformed"]) for r in settings(lines, "owner", "k", "line").collect()}
    assert found == {owner: want for owner, (_, want) in FILES.items()}
    assert settings(lines.limit(0), "owner", "k", "line").collect() == []


def test_granted(spark):
    rows = [
        ("actions", {"r": "full"}, ["full_transcript", "code_diffs"], "code", None, "", None), ("actions", {"r": "full"}, ["full_transcript"], "full", "r", None, None),
        ("full", {}, [], "full", "r", "everything", None), ("full", {}, [], "full", "r", "code", "prompts"), ("hashes_only", {}, ["tool_calls"], None, "", None, None),
    ]
    df = spark.createDataFrame(rows, "tier string, repo_tiers map<string,string>, categories array<string>, most string, repository string, environment string, flag string")
    now = [tuple(r.now) for r in df.select(granted(*(F.col(c) for c in df.columns)).alias("now")).collect()]
    assert [t for t, _ in now] == ["actions", "full", "hashes_only", "prompts", "hashes_only"] and set(TIERS) > {t for t, _ in now}
    assert [c for _, c in now] == [CATEGORIES[:6], CATEGORIES, [], CATEGORIES[:2], []]


def test_cut_bytes(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("aé€😀\n") for _ in range(r.randrange(12))) for _ in range(400)] + [None, ""]
    for most in (1, 2, 5, 9):
        found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cut_bytes(F.col("t"), most, CUT).alias("cut")).collect()
        for row in found:
            data = None if row["t"] is None else row["t"].encode()
            if data is None or len(data) <= most:
                assert row["cut"] == row["t"]
                continue
            whole = data[:most].decode("utf-8", "ignore")
            assert row["cut"] == whole + "\ufffd" * (most - len(whole.encode())) + CUT
