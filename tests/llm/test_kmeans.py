import hashlib
import random

import numpy as np
import pytest

from veilspark.llm import kmeans


def brute(rows, k, rounds, dims, scale=256, salt="2:"):
    v = [(i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in e)) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    c = [list(x) for i, x in sorted(v, key=lambda r: (hashlib.sha256((salt + ("" if r[0] is None else str(r[0]))).encode()).hexdigest(), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in v]
        for j in range(len(c)):
            if mine := [x for (_, x), o in zip(v, own, strict=True) if o == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [near(x) for _, x in v]
    sums = {j: sum(d for d, o in last if o == j) for _, j in last}
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(v, last, strict=True)]


@pytest.mark.parametrize(("dims", "k", "wide", "n"), [(2, 5, 1.0, 400), (3, 7, 4000.0, 200), (8, 12, 1.0, 300), (4, 40, 1.0, 20), (2, 3, 0.004, 60), (2, 1, 1.0, 20)])
def test_kmeans(spark, dims, k, wide, n):
    rng = random.Random(dims * k)
    rows = [(i, [rng.gauss(rng.choice([-2, 0, 3]), 0.5) * wide for _ in range(dims)]) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(n, n + n // 3)]  # copies
    rows += [(None, rows[1][1]), (5, rows[2][1]), (900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1)), (905, [0.0] * (dims + 1))]
    df = spark.createDataFrame([(i, e, 1, 0.5) for i, e in rows], "vec_id long, embedding array<float>, cluster int, upper double").repartition(5)
    got = kmeans.digest(df, k=k, rounds=4, dims=dims)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, k, 4, dims), key=str)


def test_kmeans_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert kmeans.digest(spark.createDataFrame([], kind)).collect() == []
    one = kmeans.digest(spark.createDataFrame([(1, [0.5, -0.001])], kind), dims=2).collect()
    assert [tuple(r)[:5] for r in one] == [(1, 0, 0, 0, 0)]
    with pytest.raises(Exception, match="beyond"):
        kmeans.digest(spark.createDataFrame([(1, [1e30, 0.0])], kind), dims=2).collect()


def test_bounds_are_loosened_enough_and_less_than_by_drift():
    rng = np.random.default_rng(4)
    less = 0
    for _ in range(300):
        dims = rng.integers(1, 6)
        old = rng.integers(-50, 50, (4, dims))
        new = old + rng.integers(-20, 21, (4, dims))
        radius = rng.random(4) * rng.choice([0.0, 5, 60])
        drift, loose = kmeans.loosening(old, new, radius)
        for i in range(4):
            step = rng.normal(size=(200, dims))
            x = old[i] + step / np.linalg.norm(step, axis=1)[:, None] * radius[i] * rng.random((200, 1)) ** (1 / dims)
            others = [j for j in range(4) if j != i]
            nearer = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
            assert nearer <= loose[i] + 1e-9
            assert loose[i] <= max(drift[j] for j in others) * (1 + 1e-8) + 1e-8
            less += loose[i] < 0.9 * max(drift[j] for j in others)
    assert less > 300


def test_few_vectors_are_scanned_after_the_first_rounds():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 40, (500, 8)) + 400 * rng.integers(-1, 2, 8) for _ in range(6)])
    c = x[::520].copy()
    own, upper, lower = kmeans.nearest(x, c)
    scanned = []
    for _ in range(5):
        new = np.array([x[own == j].mean(0) // 1 if (own == j).any() else c[j] for j in range(len(c))]).astype(np.int64)
        change = kmeans.loosening(c, new, np.array([upper[own == j].max(initial=0) for j in range(len(c))]))
        c = new
        own, upper, lower, n = kmeans.moved(x, c, own, upper, lower, *change)
        assert (own == kmeans.squared(x, c).argmin(1)).all()
        scanned.append(n)
    assert scanned[-1] < len(x) // 10


def test_distances_are_exact_for_large_components():
    x = np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, 5]], dtype=np.int64)
    c = np.array([[-(1 << 27), 1 << 27], [3, 4]], dtype=np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    assert kmeans.squared(x, c).tolist() == want
