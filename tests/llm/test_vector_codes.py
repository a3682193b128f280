"""Product codes against plain Python integers, the transform against its matrix, and edge cases."""

import hashlib
import math
import random

import numpy as np

from tracewell.llm import vector_codes as v


def brute(rows):
    """rows: (vec_id, embedding, label), vectors of one length that 16 divides; the contract word for word."""
    kept = [(i, [math.floor(256 * c) for c in e], label) for i, e, label in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    width = len(kept[0][1]) // 16
    part = lambda x, p: x[p * width : (p + 1) * width]
    firsts = sorted(kept, key=lambda r: (r[0], r[1]))[:64]
    books = [[part(x, p) for _, x, _ in firsts] for p in range(16)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda x, p: min((far(part(x, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        taken = [[[] for _ in b] for b in books]
        for _, x, _ in kept:
            for p in range(16):
                taken[p][near(x, p)[1]].append(part(x, p))
        books = [[[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else e for e, xs in zip(b, t, strict=True)] for b, t in zip(books, taken, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{near(x, p)[1]:02x}" for p in range(16)), sum(near(x, p)[0] for p in range(16)), label) for i, x, label in kept]
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted((i, code, e, total[label], sha) for i, code, e, label in out)


SCHEMA = "code string, vec_id long, embedding array<float>, label int, x int, k int"


def result(spark, rows):
    df = spark.createDataFrame([("c", i, e, label, 1, 2) for i, e, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in v.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=lambda r: (r[0] is None, r[0], r[1:]))


def test_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5, rng.gauss(0, 1))) for _ in range(48)], rng.choice((None, 1, 2))) for i in range(150)]
    rows += [(200 + i, rows[0][1], 1) for i in range(60)]
    rows += [(300, None, 1), (301, [None] + [0.0] * 47, 1), (302, [float("nan")] * 48, None), (303, [float("inf")] * 48, 2)]
    assert result(spark, rows) == brute([(i, e if e is None else [c if c is None else float(np.float32(c)) for c in e], label) for i, e, label in rows])


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.choice((-1e6, 1e6, 123456.789, rng.gauss(0, 1e5))))) for _ in range(64)], i % 2) for i in range(90)]
    assert result(spark, rows) == brute(rows)


def test_transform_is_in_order_of_sequency():
    for size in (1, 2, 4, 8, 32):
        rows = v.walsh(np.eye(size, dtype=np.int64)).T
        assert (rows @ rows.T == size * np.eye(size)).all()
        assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(size))


def test_nearest_with_ties_and_padding():
    rng = np.random.Generator(np.random.PCG64(5))
    for width in (1, 3, 5, 8):
        x, e = rng.integers(-3, 3, (400, width)), rng.integers(-3, 3, (40, width))
        far = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        size = 1 << (width - 1).bit_length()
        index, scaled = v.nearest(v.walsh(x), v.walsh(e))
        assert (index == far.argmin(axis=1)).all() and (scaled == size * far.min(axis=1)).all()


def test_odd_tables(spark):
    assert result(spark, []) == []
    got = result(spark, [(None, [], 1), (1, [0.5] * 5, None), (1, [0.5] * 5, None), (2, [1e30] * 16, 1), (3, [-1e30] * 16, 1)])
    assert [r[1:4] for r in got][-1] == ("00" * 16, 0, 0)
    assert len(got) == 5 and [r[1] for r in got if r[0] == 1] == ["00" * 16] * 2 and {r[1] for r in got if r[0] in (2, 3)} == {"00" * 16, "01" * 16}


def test_few_sums_leave_a_task(spark):
    vectors = v.integer_vectors(spark.range(5000).selectExpr("id AS vec_id", "transform(sequence(1, 32), k -> rand(7)) AS embedding", "1 AS label"))
    plan = v.encode(vectors, v.first_books(vectors))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
