"""k-means with all starts in one pass."""

import random

import pytest

from gridindex.operators import stats


def blobs(seed, n=300):
    rng = random.Random(seed)
    return [(i, *(rng.gauss((i % 5) * 3 + d, 1.0) for d in range(3))) for i in range(n)]


def plain(points, centres, iterations=100):
    for _ in range(iterations):
        groups = [[] for _ in centres]
        for p in points:
            groups[min(range(len(centres)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(p, centres[i])), i))].append(p)
        centres = [[sum(x) / len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    return centres, sum(min(sum((a - b) ** 2 for a, b in zip(p, c)) for c in centres) for p in points)


def test_every_start_is_that_start_alone(spark):
    df = spark.createDataFrame(blobs(1), "id int, a double, b double, c double")
    rows, tried = stats.kmeans_starts(df, ["a", "b", "c"], "id", k=4, starts=8)
    points = [list(r["__z"]) for r in rows.collect()]
    first = {tuple(map(tuple, s.centres)) for s in stats.lloyd(rows, "__z", [[p[:] for p in points[:4]]], 0)}
    assert first == {tuple(map(tuple, points[:4]))}
    import hashlib

    order = sorted(rows.collect(), key=lambda r: hashlib.md5(f"42:{r.id}".encode()).hexdigest())
    for k, s in enumerate(tried):
        centres, inertia = plain(points, [list(r["__z"]) for r in order[4 * k : 4 * k + 4]])
        assert s.inertia == pytest.approx(inertia, rel=1e-9)
        assert all(x == pytest.approx(y, abs=1e-7) for c, d in zip(s.centres, centres) for x, y in zip(c, d))


def test_the_best_start_is_taken(spark):
    df = spark.createDataFrame(blobs(2), "id int, a double, b double, c double")
    rows, tried = stats.kmeans_starts(df, ["a", "b", "c"], "id", k=5)
    assert len(tried) == 20
    found = stats.kmeans(df, ["a", "b", "c"], "a", "id", k=5).collect()
    z = {r.id: r["__z"] for r in rows.collect()}
    total = 0.0
    for c in {r.cluster for r in found}:
        own = [z[r.id] for r in found if r.cluster == c]
        mean = [sum(x) / len(own) for x in zip(*own)]
        total += sum((a - b) ** 2 for p in own for a, b in zip(p, mean))
    assert all(total <= s.inertia + 1e-6 for s in tried) and total == pytest.approx(min(s.inertia for s in tried))
    means = [sum(r.a for r in found if r.cluster == c) / sum(r.cluster == c for r in found) for c in range(5)]
    assert means == sorted(means, reverse=True)


def test_few_rows(spark):
    few = spark.createDataFrame([(1, 1.0, 2.0), (2, 5.0, 2.0), (3, None, 1.0)], "id int, a double, b double")
    assert sorted((r.id, r.cluster) for r in stats.kmeans(few, ["a", "b"], "a", "id", k=4).collect()) == [(1, 1), (2, 0)]
    assert stats.kmeans(few.limit(0), ["a", "b"], "a", "id").count() == 0


def test_nothing_stays_in_memory(spark):
    df = spark.createDataFrame(blobs(3, 60), "id int, a double, b double, c double")
    stats.kmeans(df, ["a", "b"], "a", "id", k=3, starts=3).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_iterations_are_spread(spark):
    """Few bytes and much work: rows in one partition lie in a file for each core."""
    df = spark.createDataFrame(blobs(4), "id int, a double, b double, c double").coalesce(1)
    rows, _ = stats.kmeans_starts(df, ["a", "b"], "id", k=3, starts=2)
    assert len(rows.inputFiles()) == 4 and rows.count() == 300
