"""Spelling variants against brute force over all pairs, long words, and edge cases."""

import random
import re
import zlib

from tracewell.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    counts = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def result(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    return {tuple(r) for r in spelling.grouped(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def variants(rng, size, letters):
    """Texts of words at zero to three edits of a few stems."""
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice(size))) for _ in range(12)]
    words = []
    for stem in stems:
        words += [stem] * 400
        for _ in range(40):
            w = stem
            for _ in range(rng.choice((1, 1, 2, 3))):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))
            words += [w] * rng.choice((5, 6, 30, 90))
    rng.shuffle(words)
    return words


def test_brute_force(spark):
    rng = random.Random(4)
    words = variants(rng, (6, 7, 8, 11), "abÀé")
    docs = [(k, rng.choice((" ", "\n", "-", "1")).join(words[k : k + 50])) for k in range(0, len(words), 50)]
    docs = [(i, t.upper() if i % 3 == 0 and "é" not in t else t) for i, t in docs]
    want = brute(docs)
    assert result(spark, docs) == want and any(r[1] and r[1] != r[2] for r in want)


def test_chains_of_forms(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 625}
    docs = [(0, " ".join(w for w, k in words.items() for _ in range(k)))]
    got = result(spark, docs)
    assert got == brute(docs) and {r[2] for r in got if r[0] == "abcdef"} == {"abcggg"}


def test_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEVELS", 8)
    rng = random.Random(6)
    words = variants(rng, (7, 8, 9, 10, 14), "ab")
    docs = [(k, " ".join(words[k : k + 50])) for k in range(0, len(words), 50)]
    assert result(spark, docs) == brute(docs)
    monkeypatch.setattr(spelling, "LEVELS", 32)
    run = "a" * 3000 + "b" * 3000
    docs = [(0, " ".join([run] * 30 + [run + "b"] * 5 + ["c" + run] * 5 + [run[:-1] + "c"] * 5 + ["c" + run[1:]] * 5))]
    assert result(spark, docs) == brute(docs)


def test_odd_tables(spark):
    assert result(spark, []) == set()
    assert result(spark, [(1, None), (None, ""), (2, "short "), (3, "1234567 " * 9)]) == set()
    docs = [(None, "wordword " * 3), (None, "wordword " * 3), (7, "wordwörd wordwörd wordwörd wordwörd wordwörd")]
    assert result(spark, docs) == brute(docs)
