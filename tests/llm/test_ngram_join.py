"""The n-gram join against brute force over all pairs, and its edge cases."""

import re
import string

from tests.conftest import SMALL

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d)) for d in sets}


def test_all_documents(spark):
    from tracewell.llm.ngram_join import similar_documents

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {tuple(r) for r in similar_documents(docs).collect()}
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_copies_and_edges(spark):
    from tracewell.llm.ngram_join import similar_documents

    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(12):  # a chain: neighbours are alike, ends are not
        changed = words[:]
        for j in range(k):
            changed[j * 5] = f"x{j}"
        rows.append((100 + k, " ".join(changed)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "Ünder one two three four"), (8, "ünder one two three four")]
    rows += [(200 + i, "same text that many rows hold in full " * 3) for i in range(30)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, shingles int")
    found = {tuple(r) for r in similar_documents(docs).collect()}
    assert found == brute(rows)


def test_repeated_doc_ids(spark):
    from tracewell.llm.ngram_join import similar_documents

    words = [f"w{i}" for i in range(90)]
    whole, half = " ".join(words), " ".join(words[:60] + [f"x{i}" for i in range(30)])  # 56 of 116 shingles shared
    other, near = " ".join(f"y{i}" for i in range(90)), " ".join([f"y{i}" for i in range(87)] + ["z1", "z2", "z3"])
    rows = [(1, half), (2, whole), (2, whole), (2, whole)]  # copies of 2 are one document, and unlike 1
    rows += [(4, half), (4, half)]  # a copy of 1
    rows += [(5, near), (6, whole), (6, other), (6, other), (7, "too short"), (7, "too short"), (8, None), (8, None)]  # 6 has two sets
    rows += [(None, whole), (None, whole)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in similar_documents(docs).collect())
    assert found == [(0, 0)] * 2 + [(1, 1)] + [(2, 2)] * 3 + [(4, 1)] * 2 + [(5, 2)] + [(6, 2)] * 3 + [(7, 7)] * 2 + [(8, 8)] * 2


def test_no_rows(spark):
    from tracewell.llm.ngram_join import similar_documents

    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pairs_between_parts_of_lists(spark):
    import random

    from tracewell.llm.ngram_join import crossing_pairs

    r = random.Random(5)
    rows = [(t, d, 20 + d * 7 % 90, r.choice([1, 1, 1, 2, 3, 100 + d])) for t in range(6) for d in r.sample(range(60), 25)]
    rows += [(9, d, 80 + d % 21, 1 if d else 7) for d in range(40)]  # one document outside a large part
    want = sorted(
        (a[1], b[1], a[2], b[2]) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2])
    )
    found = crossing_pairs(spark.createDataFrame(rows, "token long, doc long, n int, part long"))
    assert sorted(map(tuple, found.collect())) == want


def test_near_copies_between_groups(spark):
    import random

    from tracewell.llm.ngram_join import similar_documents

    r = random.Random(11)
    bases = [[f"b{g}_{i}" for i in range(70)] for g in range(4)]
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for d in range(160):
        words = shared + bases[d % 4][: r.choice([10, 14, 20, 70])]
        for _ in range(r.choice([0, 1, 2, 3])):
            words[r.randrange(len(words))] = f"x{r.randrange(400)}"
        rows.append((d * 3 % 160, " ".join(words)))
    found = {tuple(x) for x in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows)
