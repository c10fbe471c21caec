import hashlib
import math

import numpy as np
import pytest

from gridindex.llm import centroids


def plain(vectors, k, rounds, dim, scale=1024, seed=3):
    """Rows of cluster() by all distances, in Python's integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(now)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    own = {n: sum(d for _, c, d in found if c == n) for n in range(len(now))}
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, n, fits(d), fits(own[n]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for i, n, d in found]


def rows(spark, vectors, schema="vec_id long, embedding array<float>", **kw):
    out = centroids.cluster(spark, spark.createDataFrame(vectors, schema), **kw)
    assert ", ".join(f"{n} {t}" for n, t in out.dtypes).replace("bigint", "long") == centroids.SCHEMA
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("k,dim,spread", [(8, 64, 0.3), (40, 5, 3.0), (3, 1, 900.0)])
def test_equals_plain(spark, k, dim, spread):
    rng = np.random.default_rng(k)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(i % 7, spread, dim)]) for i in range(400)] + [(i, [0.5] * dim) for i in range(1000, 1200)]
    assert rows(spark, vectors, k=k, rounds=5, dim=dim) == sorted(plain(vectors, k, 5, dim), key=repr)


def test_search_is_exact_and_rejects():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (3000, 64)) + rng.integers(-400, 400, (3000, 1))
    c = [[int(v) for v in row] for row in x[:200]] + [[int(v) for v in x[0]]]  # two equal centroids: the first one wins
    number, best, worked = centroids.nearest(x, centroids.ordered(c))
    all_ = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(-1)
    assert (number == all_.argmin(1)).all() and (best == all_.min(1)).all()
    assert worked < 0.2 * all_.size


def test_vectors_left_out_and_ties(spark):
    good = [0.25, -0.25]
    vectors = [(1, good), (1, good), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [9.0, 9.0]), (9, [0.0, 0.0]), (10, [0.5, -0.5])]
    got = rows(spark, vectors, k=2, rounds=3, dim=2)
    assert got == sorted(plain(vectors, 2, 3, 2), key=repr) and len(got) == 5


def test_large_components(spark):
    vectors = [(i, [float(np.float32(s * 10.0**e)), 1.0]) for i, (s, e) in enumerate([(1, 38), (-3, 38), (1, 5), (2, 5), (5, 6), (-2, 12), (1, 0), (2, 0)])]
    assert rows(spark, vectors, k=3, rounds=4, dim=2) == sorted(plain(vectors, 3, 4, 2), key=repr)


def test_few_none_and_other_columns(spark):
    assert rows(spark, [(4, [1.0, 1.0])], k=8, dim=2)[0][:4] == (4, 0, 0, 0)
    assert rows(spark, [], dim=2) == []
    wide = spark.createDataFrame([(1, [1.0, 2.0], 7, 8, "y")], "vec_id int, embedding array<double>, cluster int, x int, centroid_sha256 string")
    assert [r["cluster"] for r in centroids.cluster(spark, wide, dim=2).collect()] == [0]
