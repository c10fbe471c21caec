"""Centroid clustering in whole numbers, with the equal-average equal-variance search for the nearest centroid.

Of two vectors, let f be the sum of components over the root of their number and v the norm of what remains beside the
mean. Then the squared distance is at least (f - f')**2 and at least (f - f')**2 + (v - v')**2. Centroids lie sorted by f;
each vector starts at its own f and looks outward, to whichever side is nearer, until the first bound exceeds the best
distance; the second bound rejects centroids without their components being read. Both are taken a little low, for the
rounding of floats; what remains is decided by exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.llm.ranges import checkpointed

SCALE, DIM, K, ROUNDS, SEED = 1024, 64, 8, 10, 3
_ROWS = 4096
#: Components below this keep every squared distance within 64 bits; larger ones are worked out in Python's own integers.
_NARROW = 1 << 27
_FLOAT_MAX = 3.4028234663852886e38
_LIMB = 62

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Sorted(NamedTuple):
    """Centroids in ascending order of f: their numbers, f, v and components."""

    number: np.ndarray
    f: np.ndarray
    v: np.ndarray
    rows: np.ndarray


def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = rows.astype(float)
    mean = x.mean(axis=1)
    return mean * np.sqrt(x.shape[1]), np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1))


def ordered(centroids: list[list[int]]) -> Sorted:
    rows = narrow(np.array(centroids, object))
    f, v = features(rows)
    order = np.argsort(f, kind="stable")
    return Sorted(order, f[order], v[order], rows[order])


def narrow(rows: np.ndarray) -> np.ndarray:
    """64-bit where no squared distance can leave it, else Python's integers."""
    return rows.astype(np.int64) if not rows.size or max(abs(rows.min()), abs(rows.max())) < _NARROW else rows.astype(object)


def nearest(rows: np.ndarray, centroids: Sorted) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid (ties: the smallest), the squared distance, and how many distances were worked out."""
    n, k = len(rows), len(centroids.f)
    wide = rows.dtype == object or centroids.rows.dtype == object
    f, v = features(rows)
    slack = 2.0**-40 * (np.abs(f) + v + np.abs(centroids.f).max() + centroids.v.max())
    right = np.searchsorted(centroids.f, f)
    left = right - 1
    best = np.full(n, -1, object if wide else np.int64)
    bound = np.full(n, np.inf)  # of best, a little high
    number = np.full(n, -1, np.int64)
    edge = np.concatenate([[-np.inf], centroids.f, [np.inf]])
    open_, worked = np.arange(n), 0
    while len(open_):
        below, above = f[open_] - edge[left[open_] + 1], edge[right[open_] + 1] - f[open_]
        down = below <= above
        gap = np.maximum(np.minimum(below, above) - slack[open_], 0) ** 2
        go = np.isfinite(gap) & (gap <= bound[open_])
        open_, down, gap = open_[go], down[go], gap[go]
        at = np.where(down, left[open_], right[open_])
        left[open_[down]] -= 1
        right[open_[~down]] += 1
        gap += np.maximum(np.abs(v[open_] - centroids.v[at]) - slack[open_], 0) ** 2
        keep = gap <= bound[open_]
        who, at = open_[keep], at[keep]
        worked += len(who)
        distance = ((rows[who] - centroids.rows[at]) ** 2).sum(axis=1)
        own, old = centroids.number[at], best[who]
        better = (number[who] < 0) | (distance < old) | ((distance == old) & (own < number[who]))
        who, distance, own = who[better], distance[better], own[better]
        best[who], number[who] = distance, own
        bound[who] = distance.astype(float) * (1 + 1e-9)
    return number, best, worked


def kept(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and the vectors of exactly dim components, none null, non-finite or beyond the range of 32-bit floats."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))
    wide = F.col("x").cast("array<double>")
    return whole.filter((F.size("x") == dim) & F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= _FLOAT_MAX)))


def whole_numbers(column: pa.ListArray, dim: int, scale: int) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) * float(scale))
    if not x.size or np.abs(x).max() < _NARROW:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x], object)


def initial(rows: DataFrame, k: int, dim: int, scale: int, seed: int) -> list[list[int]]:
    """At most k vectors, by the hash of their ids; rows that share an id in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()  # k rows, a parameter
    return [[int(c) for c in np.floor(np.array(r["x"], float) * float(scale))] for r in first]


def _sums(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[tuple[int, list[int]]]:
    """Count and sum of components of each centroid's vectors. A task gives dim rows a cluster; sums are in two limbs, so none overflows."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = ordered(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = whole_numbers(batch.column(0).slice(at, _ROWS), dim, scale)
                number, _, _ = nearest(x, near)
                for c in np.unique(number):
                    own = x[number == c]
                    n[c] += len(own)
                    sums[c] += own.sum(axis=0).astype(object)
        used = [(c, d) for c in range(k) if n[c] for d in range(dim)]
        if used:
            values = [int(sums[c, d]) for c, d in used]
            arrays = [pa.array([c for c, _ in used], pa.int32()), pa.array([d for _, d in used], pa.int32()), pa.array([int(n[c]) for c, _ in used], pa.int64())]
            limbs = [pa.array([Decimal(v >> _LIMB) for v in values], pa.decimal128(38, 0)), pa.array([Decimal(v & (1 << _LIMB) - 1) for v in values], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(arrays + limbs, ["cluster", "place", "n", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "cluster int, place int, n long, high decimal(38,0), low decimal(38,0)")
    counts, totals = [0] * k, [[0] * dim for _ in range(k)]
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # k * dim rows
        counts[r["cluster"]], totals[r["cluster"]][r["place"]] = r["n"], (int(r["high"]) << _LIMB) + int(r["low"])
    return list(zip(counts, totals, strict=True))


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """The centroids after so many rounds over rows (vec_id, x). A round that moves none ends it: all later ones would be the same."""
    now = initial(rows, k, dim, scale, seed)
    for _ in range(rounds if now else 0):
        moved = [[s // n for s in sums] if n else old for (n, sums), old in zip(_sums(rows, now, dim, scale), now, strict=True)]
        if moved == now:
            break
        now = moved
    return now


def assigned(rows: DataFrame, centroids: list[list[int]], dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance for every row (vec_id, x); a squared distance beyond 64 bits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = ordered(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                number, distance, _ = nearest(whole_numbers(part.column(1), dim, scale), near)
                exact = pa.array(distance if distance.dtype != object else [int(d) if d < 1 << 63 else None for d in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), exact], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(spark: SparkSession, vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row for each kept vector of vectors (vec_id, embedding): its cluster, squared distance, the sums of distances in
    its cluster and overall, and the digest of its centroid.

    Vectors that are null, of another length, or with a null, non-finite or (in 64-bit floats) larger component than a 32-bit
    float holds are left out; a null vec_id stays and never starts a cluster unless too few others are there; repeated rows stay
    repeated, as starts too; fewer than k vectors give as many centroids; sums beyond 64 bits are null; an empty table gives no rows; other columns are
    ignored. Every round is one pass that shuffles k * dim sums a task; a cluster of any size is never gathered.
    """
    rows = checkpointed(spark, kept(vectors, dim), "centroids")  # every round reads them
    centroids = fit(rows, k, rounds, dim, scale, seed)
    if not centroids:
        return spark.createDataFrame([], SCHEMA)
    found = checkpointed(spark, assigned(rows, centroids, dim, scale), "centroids")
    parts = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()  # k rows
    sums = {r["cluster"]: None if r["beyond"] else int(r["total"]) for r in parts}
    overall = None if None in sums.values() else sum(sums.values())
    fits = {c: n if n is not None and n < 1 << 63 else None for c, n in [*sums.items(), (None, overall)]}
    digests = {c: sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in sums}
    totals = spark.createDataFrame([(c, fits[c], fits[None], digests[c]) for c in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select(*(c.split()[0] for c in SCHEMA.split(", ")))
