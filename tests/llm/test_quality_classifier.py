"""The quality classifier on held-out labels, and its edge cases."""

import zlib

import numpy as np

from tests.conftest import MEDIUM


def test_held_out_accuracy(spark):
    from tracewell.llm.quality_classifier import scored

    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in scored(docs, labels).collect()}
    assert len(found) == docs.count()
    truth = [(found[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in found]
    held = [(r, y) for r, y in truth if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r, _ in truth)
    assert len(held) > 40 and np.mean([r.predicted == y for r, y in held]) >= 0.95
    good, bad = ([r.score for r, y in held if y == k] for k in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.97


def test_edges(spark):
    from tracewell.llm.quality_classifier import scored

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (2, None), (9, 0)], "doc_id long, quality int")
    rows = scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in scored(docs, labels.limit(0)).collect()} and scored(docs.limit(0), labels).collect() == []


def twin(texts, labels):
    """Scores by plain numpy, from documents (doc_id, text) and labels {doc_id: y}."""
    from tracewell.llm import quality_classifier as q
    from tracewell.llm.textbytes import buffers

    import pyarrow as pa

    x = q.statistics(*buffers(pa.array([t for _, t in texts], pa.string()))).astype(np.float32).astype(float)
    part = [zlib.crc32(str(d).encode()) % 5 for d, _ in texts]
    known = [i for i, (d, _) in enumerate(texts) if d in labels and part[i] != 0]
    ridge, rest = [i for i in known if part[i] != 1], [i for i in known if part[i] == 1]
    y = np.array([labels.get(d, 0) for d, _ in texts], float)
    mean, scale = (v.astype(np.float32).astype(float) for v in (x[ridge].mean(axis=0), x[ridge].std(axis=0)))
    scale[scale < 1e-6] = 1
    r = np.random.Generator(np.random.PCG64(q.SEED))
    w = r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], q.FEATURES))
    b = r.uniform(0, 2 * np.pi, q.FEATURES)
    z = np.clip((x - mean) / scale, -4, 4)
    f = np.hstack([np.ones((len(x), 1)), z, np.cos(z @ w + b) * np.sqrt(2 / q.FEATURES)])
    g = np.rint(f[ridge] * q.GRID) / q.GRID
    penalty = np.full(f.shape[1], q.RIDGE * len(ridge) / f.shape[1])
    penalty[0] = 1e-9
    raw = np.clip(f @ np.linalg.solve(g.T @ g + np.diag(penalty), g.T @ y[ridge]), -1, 2)
    at = np.minimum(((raw + 1) / 3 * q.BINS).astype(int), q.BINS - 1)
    used = sorted({at[i] for i in rest})
    n = np.array([sum(at[i] == k for i in rest) for k in used], float)
    m = np.array([np.mean([y[i] for i in rest if at[i] == k]) for k in used])
    # Isotonic regression by its max-min formula.
    level = [max(min(np.average(m[a : e + 1], weights=n[a : e + 1]) for e in range(k, len(m))) for a in range(k + 1)) for k in range(len(m))]
    score = np.interp(raw, (np.array(used) + 0.5) / q.BINS * 3 - 1, level)
    return {d: s for (d, _), s in zip(texts, (1 - q.TIE_SHARE) * score + q.TIE_SHARE * (raw + 1) / 3, strict=True)}


def test_scores_equal_a_plain_twin_however_rows_are_dealt(spark):
    from tracewell.llm.quality_classifier import scored

    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r.score for r in scored(docs, labels).collect()}
    want = twin([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.quality for r in labels.collect()})
    assert found.keys() == want.keys() and max(abs(found[d] - want[d]) for d in want) < 1e-6
    again = {r.doc_id: r.score for r in scored(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == found
