"""Embedding links against brute force over all pairs, and edge cases."""

import numpy as np

from tests.conftest import SMALL


def brute(rows):
    good = {}
    for i, v in rows:
        v = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(1)
        if np.isfinite(v).all() and np.any(v):
            good[i] = v / np.linalg.norm(v)
    ids = sorted(good)
    hit = np.array([[a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9 for b in ids] for a in ids])
    part = np.arange(len(ids))
    while True:
        new = np.array([min(part[k], *part[hit[k]]) if hit[k].any() else part[k] for k in range(len(ids))])
        if (new == part).all():
            break
        part = new
    known = {i: (int(hit[k].sum()), ids[part[k]]) for k, i in enumerate(ids)}
    return {(i, *known.get(i, (0, i)), known.get(i, (0, i))[1] == i) for i, _ in rows}


def test_all_vectors(spark, monkeypatch):
    from tracewell.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "PART", 50)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 20)
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert {tuple(r) for r in embedding_dedup.linked_vectors(vectors).collect()} == brute([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_groups_and_edges(spark, monkeypatch):
    from tracewell.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 8))
    rows = [(i, [float(c) for c in np.float32(base[i % 6] + r.normal(size=8) * 0.3)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(20)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] + [0.0] * 6), (304, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rep int, unit int")
    assert {tuple(x) for x in embedding_dedup.linked_vectors(df).collect()} == brute(rows)
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in embedding_dedup.linked_vectors(one).collect()] == [(1, 0, 1, True)]
    assert embedding_dedup.linked_vectors(one.limit(0)).collect() == []


def test_lengths_and_many_cells(spark, monkeypatch):
    from tracewell.llm import embedding_dedup

    probe = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, []), (7, [2.0])]
    df = spark.createDataFrame(probe, "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in embedding_dedup.linked_vectors(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True)]
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 1)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 2)
    monkeypatch.setattr(embedding_dedup, "PART", 3)
    r = np.random.default_rng(8)
    rows = [(i, [float(c) for c in np.float32(r.normal(size=4 + i % 2) + 2 * (i % 3))]) for i in range(1_300)]
    assert {tuple(x) for x in embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()} == brute(rows)


def test_a_vec_id_of_several_vectors(spark):
    from tracewell.llm.embedding_dedup import linked_vectors

    rows = [(1, [1.0, 0.0]), (5, [1.0, 0.01]), (5, [0.0, 1.0]), (7, [0.01, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(((x.vec_id or 0), x.n_links, x.component_id) for x in linked_vectors(df).collect())
    assert found == [(0, 0, None), (1, 1, 1), (5, 1, 1), (5, 1, 1), (7, 1, 1)]
