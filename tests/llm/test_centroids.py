"""Centroid clustering against exact integers in plain Python, with vectors of any magnitude."""

import hashlib
import math

import numpy as np
import pytest

from lamina.llm import centroids


def brute(rows, k, rounds, scale, seed, dims):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, m), j) for j, m in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        own = assign() if c else []
        for j in range(len(c)):
            mine = [v for (_, v), (_, b) in zip(kept, own, strict=True) if b == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own, long = assign(), lambda v: v if v < 2**63 else None
    total = sum(d for d, _ in own)
    return sorted((str(i), b, long(d), long(sum(x for x, y in own if y == b)), long(total), hashlib.sha256(",".join(map(str, c[b])).encode()).hexdigest()) for (i, _), (d, b) in zip(kept, own, strict=True))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **kw).collect())


KW = {"k": 5, "rounds": 4, "scale": 256, "seed": 2, "dims": 3}


@pytest.mark.parametrize("magnitude", [1.0, 1e5, 1e12, 1e30])
def test_equals_brute_force(spark, magnitude):
    """float64 products, int64 and Python integers give the same exact result, also side by side."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    rows += [(100 + i, [float(x) * magnitude for x in rng.normal(size=3)]) for i in range(12)]
    assert run(spark, rows, **KW) == brute(rows, **KW)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [1.0, -inf, 1.0]), (7, [1.0, 2.0, 3.0, 4.0])]
    assert run(spark, rows, **KW) == []  # none is usable
    rows += [(8, [0.5, -0.5, 0.0]), (8, [0.5, -0.5, 0.0]), (8, [0.25, 0.5, 1.0]), (None, [-1.5, 2.0, 0.1])]
    assert run(spark, rows, **KW) == brute(rows, **KW)  # fewer vectors than centroids, repeated and null ids
    same = [(i, [1.0, 1.0, 1.0]) for i in range(30)] + [(30, [-3.0, 0.0, 9.0])]
    assert run(spark, same, **KW) == brute(same, **KW)  # ties go to the smaller number, centroids without vectors stay


def test_bounds():
    low, high = centroids.reaches(64)
    assert 64 * (2 * low + 2) ** 2 <= 2**53 and 64 * (2 * high + 2) ** 2 <= 2**63
    x = np.full((2, 64), low, dtype=np.int64)
    assert centroids.distances(x, -x, 0).tolist() == centroids.distances(x, -x, 2).tolist()
    assert centroids.distances(x, -x, 1).tolist() == centroids.distances(x, -x, 2).tolist()
