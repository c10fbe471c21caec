"""Nearest points, zonal statistics and polygon overlap, by equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridindex.functions.grid import axial, cell_area, cell_id, grid_disk, offsets
from gridindex.shared import written


#: Points that a square holds for each neighbour asked for, before it is cut into sixteen; how often a square may be cut.
CROWD, CUTS = 4, 12
_FINE = 1 << 2 * CUTS


def _squares(points: DataFrame, x0: float, y0: float, span: float, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(points with the square each lies in: level, i, j; squares that are cut: level, i, j, kids).

    Squares are of unequal size: one with more than crowd points is cut into sixteen, so crowded places have small ones. The
    ancestors of a square are the leading bits of its numbers. Counts of all levels are one aggregate.
    """
    spark = points.sparkSession
    fine = lambda c, o: F.greatest(F.least(F.floor((F.col(c) - o) / span * _FINE), F.lit(_FINE - 1)), F.lit(0)).cast("long")
    placed = written(spark, points.withColumns({"__fi": fine("x", x0), "__fj": fine("y", y0)}))
    at = lambda c, level: F.expr(f"shiftright({c}, 2 * ({CUTS} - {level}))")
    counts = placed.groupBy("__fi", "__fj").agg(F.count("*").alias("n"))
    levels = counts.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(CUTS)))).groupBy("level", at("__fi", "level").alias("i"), at("__fj", "level").alias("j")).agg(F.sum("n").alias("n"))
    kid = F.struct("level", "i", "j", "n")
    cut = levels.groupBy((F.col("level") - 1).alias("level"), F.shiftright("i", 2).alias("i"), F.shiftright("j", 2).alias("j")).agg(F.collect_list(kid).alias("kids"), F.sum("n").alias("n"))
    cut = written(spark, cut.filter(F.col("n") > crowd).drop("n"))  # at most sixteen kids
    deepest = cut.agg(F.max("level")).head()[0]
    if deepest is None:
        return placed.withColumns({"level": F.lit(0), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")}), cut
    above = placed.select("__fi", "__fj").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumns({"i": at("__fi", "level"), "j": at("__fj", "level")})
    own = above.join(cut, ["level", "i", "j"], "left_semi").groupBy("__fi", "__fj").agg((F.max("level") + 1).alias("level"))
    return placed.join(own, ["__fi", "__fj"]).withColumns({"i": at("__fi", "level"), "j": at("__fj", "level")}), cut


def knn_join(targets: DataFrame, points: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """target_id, point_id, distance, rank: the k nearest points (fewer where there are fewer), ties by point_id.

    targets: target_id, x, y; points: point_id, x, y and what else to carry. Of the points at one place only the k first can
    be among the nearest, and only they go on. Each target goes down the squares of the points, keeping those that can hold
    one of its k nearest: the k-th smallest of their farthest distances bounds the k-th neighbour's, and squares that begin
    beyond it are left. Only the points of the squares that are left in the end are met, however many lie elsewhere.
    """
    nearest = Window.partitionBy("target_id").orderBy("distance", "point_id")
    return met_points(targets, points, k, max_distance).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def met_points(targets: DataFrame, points: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """target_id, distance and the points' columns for the few points among which each target's k nearest are (knn_join)."""
    x0, x1, y0, y1, n = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).head()
    carried = [c for c in points.columns if c not in ("x", "y")]
    if not n:
        return targets.select("target_id").join(points.select(*carried, F.lit(0.0).alias("distance")).limit(0), F.lit(True)).limit(0)
    span = max(x1 - x0, y1 - y0, 1e-9)
    pad = (span + abs(x0) + abs(y0)) * 1e-12  # what rounding may move a point across a side
    first = Window.partitionBy("x", "y").orderBy("point_id")  # cut to k rows a place before the shuffle, too
    few = points.withColumn("__place", F.row_number().over(first)).filter(F.col("__place") <= k).drop("__place")
    held, cut = _squares(few, x0, y0, span, CROWD * k)

    def gaps(c: str, low: Column, side: Column) -> tuple[Column, Column]:
        """How far a square begins and ends from the target along one axis."""
        a, b = low - F.col(c), F.col(c) - low - side
        return F.greatest(a, b, F.lit(0.0)), F.greatest(-a, -b)

    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bounded(rows: DataFrame) -> DataFrame:
        """target_id, x, y and the squares that can hold one of its k nearest, from rows of a target and a square s.

        Targets lie in as many tasks as shuffle partitions: their rows are few bytes for much work, and would be put together.
        """
        side = F.lit(span) / F.pow(F.lit(4.0), F.col("s.level"))
        (nx, fx), (ny, fy) = gaps("x", x0 + F.col("s.i") * side, side), gaps("y", y0 + F.col("s.j") * side, side)
        one = F.struct((F.sqrt(fx * fx + fy * fy) + pad).alias("far"), (F.sqrt(nx * nx + ny * ny) - pad).alias("near"), F.col("s.level").alias("level"), F.col("s.i").alias("i"), F.col("s.j").alias("j"), F.col("s.n").alias("n"))
        each = rows.select("target_id", "x", "y", one.alias("s")).repartition(tasks, "target_id").groupBy("target_id", "x", "y").agg(F.array_sort(F.collect_list("s")).alias("squares"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("far"))
        reached = F.aggregate("squares", start, lambda s, q: F.struct((s["n"] + q["n"]).alias("n"), F.when((s["n"] < k) & (s["n"] + q["n"] >= k), q["far"]).otherwise(s["far"]).alias("far")))
        bound = reached["far"] if max_distance is None else F.least(reached["far"], F.lit(float(max_distance) + pad))
        # bound once by a lambda: as a column it would be put into the filter and worked out anew for each square
        kept = F.transform(F.array(bound), lambda b: F.filter("squares", lambda q: q["near"] <= b))[0]
        return each.select("target_id", "x", "y", kept.alias("squares"))

    root = F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(n).cast("long").alias("n"))
    left = bounded(targets.select("target_id", "x", "y", root.alias("s")))
    deepest = cut.agg(F.max("level")).head()[0]
    for level in range(0 if deepest is None else deepest + 1):
        here = cut.filter(F.col("level") == level).select("level", "i", "j", "kids")
        here = F.broadcast(here) if level <= 3 else here  # at most 4096 squares
        square = F.struct("q.level", "q.i", "q.j", "q.n")
        opened = left.select("target_id", "x", "y", F.explode("squares").alias("q")).select("target_id", "x", "y", "q", "q.level", "q.i", "q.j").join(here, ["level", "i", "j"], "left")
        left = bounded(opened.select("target_id", "x", "y", F.explode(F.coalesce("kids", F.array(square))).alias("s")))
    asked = left.select("target_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode("squares").alias("q")).select("target_id", "tx", "ty", "q.level", "q.i", "q.j")
    met = asked.join(held, ["level", "i", "j"]).withColumn("distance", F.sqrt((F.col("tx") - F.col("x")) ** 2 + (F.col("ty") - F.col("y")) ** 2))
    met = met if max_distance is None else met.filter(F.col("distance") <= max_distance)
    return met.select("target_id", *carried, "distance")


def gravity(targets: DataFrame, points: DataFrame, capacity: str = "capacity", k: int = 3, buffer: float = 100.0, max_distance: float | None = None) -> DataFrame:
    """Per target: the sum over its k nearest points of capacity / (distance + buffer); 0 without any."""
    near = knn_join(targets, points, k, max_distance)
    scores = near.groupBy("target_id").agg(F.sum(F.col(capacity) / (F.col("distance") + buffer)).alias("score"))
    return targets.select("target_id").join(scores, "target_id", "left").select("target_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def near_flagged(targets: DataFrame, pixels: DataFrame, distance: float) -> DataFrame:
    """target_id, distance to the nearest flagged pixel within the given distance; missing beyond it. pixels: point_id, x, y, flag."""
    flagged = pixels.filter("flag").select("point_id", "x", "y")
    found = knn_join(targets, flagged, 1, distance).select("target_id", "distance")
    return targets.select("target_id").join(found, "target_id", "left")


def zonal_mean(pixels: DataFrame, cells: DataFrame, size: float, radius: float, values: dict[str, Column]) -> DataFrame:
    """Per cell: means over the pixels within the radius of its centre. pixels: x, y and values; cells: cell_id."""
    steps = max(1, math.ceil((radius + size) / (1.5 * size)))
    q, r = axial(F.col("x"), F.col("y"), size)
    near = F.array(*(F.struct(F.lit(a).alias("q"), F.lit(b).alias("r")) for a, b in offsets(steps)))
    around = pixels.withColumns({"__q": q, "__r": r}).withColumn("__d", F.explode(near)).withColumns({"__q": F.col("__q") + F.col("__d.q"), "__r": F.col("__r") + F.col("__d.r")})
    dx, dy = F.col("x") - (F.col("__q") + F.col("__r") / 2) * (math.sqrt(3.0) * size), F.col("y") - F.col("__r") * (1.5 * size)
    inside = around.filter(dx * dx + dy * dy <= radius * radius).withColumn("cell_id", cell_id(F.col("__q"), F.col("__r")))
    found = inside.groupBy("cell_id").agg(*(F.avg(v).alias(k) for k, v in values.items()), F.count("*").alias("n_pixels"))
    return found.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")


def two_period_anomaly(df: DataFrame, key: str, when: Column, value: Column, baseline: tuple, recent: tuple) -> DataFrame:
    """The mean of the recent period less that of the baseline (ends included)."""
    mean = lambda span: F.avg(F.when(when.between(*span), value))
    return df.groupBy(key).agg((mean(recent) - mean(baseline)).alias("anomaly"))


def recurrent_exposure(events: DataFrame, base: DataFrame, size: float, k: int) -> DataFrame:
    """cell_id, n_years: in how many years each base cell had an event within k steps. Cells of a year come once before they spread."""
    q, r = axial(F.col("x"), F.col("y"), size)
    hit = events.select("year", cell_id(q, r).alias("hit")).distinct()
    spread = hit.select("year", F.explode(grid_disk(F.col("hit"), k)).alias("cell_id")).join(base.select("cell_id").distinct(), "cell_id", "left_semi")
    return spread.distinct().groupBy("cell_id").agg(F.count("*").alias("n_years"))


def extent(df: DataFrame, pad: float = 0.05) -> DataFrame:
    """One row: the bounds of x and y, widened by a share."""
    one = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    dx, dy = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    return one.select((F.col("x0") - dx).alias("x0"), (F.col("x1") + dx).alias("x1"), (F.col("y0") - dy).alias("y0"), (F.col("y1") + dy).alias("y1"))


# polygons: rings array<array<struct<x, y>>>, the first the outline, others holes


def valid_polygons(df: DataFrame) -> DataFrame:
    """Polygons with an outline of three points at least and an area."""

    def has_area(outline: Column) -> Column:
        turned = F.concat(F.slice(outline, 2, F.size(outline)), F.slice(outline, 1, 1))
        twice = F.aggregate(F.zip_with(outline, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)
        return (F.size(outline) >= 3) & (F.abs(twice) > 0)

    # the outline is bound once by a lambda: as a repeated subexpression of the filter it does not compile
    return df.filter(F.exists(F.slice("rings", 1, 1), has_area))


def _clip_areas(ring: np.ndarray, centers: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Area of a ring within a convex polygon (counter-clockwise corners) set at each of the centres.

    One copy of the ring a centre, all in one flat array, clipped by one half-plane after the other; after each, only what is
    left of the copies goes on.
    """
    m, n = len(centers), len(ring)
    points, owner = (ring[None] - centers[:, None]).reshape(-1, 2), np.repeat(np.arange(m), n)

    def following() -> np.ndarray:
        """The place of each point's successor in its own copy."""
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        after = np.arange(1, len(owner) + 1)
        after[np.append(starts[1:], len(owner)) - 1] = starts
        return after

    for a, b in zip(corners, np.roll(corners, -1, 0), strict=True):
        if not len(points):
            return np.zeros(m)
        side = (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0])
        after = following()
        side_after = side[after]
        cross = (side >= 0) != (side_after >= 0)
        share = np.where(cross, side / np.where(side == side_after, 1.0, side - side_after), 0.0)
        met = points + share[:, None] * (points[after] - points)
        keep = np.stack([side >= 0, cross], 1).ravel()
        points, owner = np.stack([points, met], 1).reshape(-1, 2)[keep], np.repeat(owner, 2)[keep]
    if not len(points):
        return np.zeros(m)
    x, y, after = points[:, 0], points[:, 1], following()
    return np.abs(np.bincount(owner, x * y[after] - y * x[after], m)) / 2


def _inside(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie in the ring (crossings of a ray to the right, odd)."""
    a, b = ring, np.roll(ring, -1, 0)
    spans = (a[:, 1] > y[:, None]) != (b[:, 1] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y[:, None] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return (np.count_nonzero(spans & (x[:, None] < at), axis=1) % 2).astype(bool)


def _edge_distance(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of points to the nearest edge."""
    a, d = ring, np.roll(ring, -1, 0) - ring
    px, py = x[:, None] - a[:, 0], y[:, None] - a[:, 1]
    t = np.clip((px * d[:, 0] + py * d[:, 1]) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.sqrt(((px - t * d[:, 0]) ** 2 + (py - t * d[:, 1]) ** 2).min(1))


def _cells_of(shapes: list[np.ndarray], low: int, high: int, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q, r, overlap area and whether the centre is inside, for cells of rows low .. high - 1 that the polygon meets."""
    width, hexagon = math.sqrt(3.0) * size, np.array([(math.cos(math.pi * (2 * k + 1) / 6), math.sin(math.pi * (2 * k + 1) / 6)) for k in range(6)]) * size
    x0, x1 = shapes[0][:, 0].min() - width, shapes[0][:, 0].max() + width
    rows = np.arange(low, high)
    first = np.floor(x0 / width - rows / 2).astype(np.int64)
    counts = np.ceil(x1 / width - rows / 2).astype(np.int64) - first + 1
    r = np.repeat(rows, counts)
    q = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    x, y = (q + r / 2) * width, r * (1.5 * size)
    area, holds = np.zeros(len(q)), np.zeros(len(q), bool)
    step = max(1, 2_000_000 // max(sum(map(len, shapes)), 1))
    for k in range(0, len(q), step):
        part = slice(k, k + step)
        px, py = x[part], y[part]
        inside = _inside(shapes[0], px, py)
        near = _edge_distance(shapes[0], px, py) < size
        for hole in shapes[1:]:
            inside &= ~_inside(hole, px, py)
            near |= _edge_distance(hole, px, py) < size
        holds[part] = inside
        area[part] = np.where(inside & ~near, cell_area(size), 0.0)
        edge = np.flatnonzero(near)  # only cells that an edge may cross are clipped
        centers = np.stack([px[edge], py[edge]], 1)
        area[k + edge] = np.maximum(_clip_areas(shapes[0], centers, hexagon) - sum(_clip_areas(s, centers, hexagon) for s in shapes[1:]), 0.0)
    met = area > 0
    return q[met], r[met], area[met], holds[met]


#: Rows of cells that one task step covers: a large polygon is split into so many strips.
STRIP = 64


def overlap_area(polygons: DataFrame, size: float) -> DataFrame:
    """feature columns, cell_id, area: the exact overlap of each polygon with each covered cell.

    Cells are covered when their centre lies in some polygon. A polygon is cut into strips of cell rows, which spread over
    tasks; a strip finds its cells by arithmetic on the bounding box, and only cells that an edge may cross are clipped.
    """
    carried = [c for c in polygons.columns if c != "rings"]
    height = 1.5 * size
    ys = F.transform(F.element_at("rings", 1), lambda p: p["y"])
    low, high = F.floor((F.array_min(ys) - size) / height), F.ceil((F.array_max(ys) + size) / height) + 1
    bounded = valid_polygons(polygons).withColumns({"__low": low, "__high": high})
    strips = bounded.withColumn("__from", F.explode(F.sequence(F.col("__low"), F.col("__high"), F.lit(STRIP)))).select(*carried, "rings", "__from", F.least(F.col("__from") + STRIP, F.col("__high")).alias("__to"))

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column("rings")
            starts = batch.column("__from").to_pylist()
            ends = batch.column("__to").to_pylist()
            took, ids, areas, holds = [], [], [], []
            for i in range(batch.num_rows):
                shapes = [np.stack([ring.values.field("x").to_numpy(), ring.values.field("y").to_numpy()], 1) for ring in rings[i] if ring.values is not None and len(ring.values) >= 3]
                q, r, area, inside = _cells_of(shapes, starts[i], ends[i], size)
                took.append(np.full(len(q), i))
                ids += [f"{a}:{b}" for a, b in zip(q.tolist(), r.tolist(), strict=True)]
                areas.append(area)
                holds.append(inside)
            at = pa.array(np.concatenate(took) if took else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in carried), pa.array(ids, pa.string()), pa.array(np.concatenate(areas) if areas else np.zeros(0)), pa.array(np.concatenate(holds) if holds else np.zeros(0, bool))], [*carried, "cell_id", "area", "holds_center"])

    kinds = dict(polygons.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "cell_id string", "area double", "holds_center boolean"])
    cut = written(polygons.sparkSession, strips.mapInArrow(clip, schema))
    covered = cut.filter("holds_center").select("cell_id").distinct()
    return cut.join(covered, "cell_id", "left_semi").drop("holds_center").select(*carried, "cell_id", "area")


class OverlapCells:
    """A table function: the cells that a polygon (rings) meets in rows low .. high - 1, with the exact overlap and whether its centre is inside."""

    def eval(self, rings: list, size: float, low: int, high: int) -> Iterator[tuple[str, float, bool]]:
        shapes = [np.array([(p["x"], p["y"]) for p in ring]) for ring in rings or [] if ring and len(ring) >= 3]
        if shapes and rings[0] and len(rings[0]) >= 3:
            for q, r, area, inside in zip(*(c.tolist() for c in _cells_of(shapes, low, high, size)), strict=True):
                yield f"{q}:{r}", area, inside


def reference_fractions(polygons: DataFrame, size: float) -> DataFrame:
    """Per covered cell: high-class fraction, greatest class, coverage, records and the dominant state."""
    from gridindex.operators.tables import area_by_cell, with_fractions

    return with_fractions(area_by_cell(overlap_area(polygons.filter("class >= 0"), size)), cell_area(size))


def simplify_rings(polygons: DataFrame, tolerance: float) -> DataFrame:
    """Rings with fewer points, none further than the tolerance from the line that replaces it; rings of under three points go."""

    def thin(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        p = np.array(points)
        if len(p) < 4:
            return points
        keep = np.zeros(len(p), bool)
        far = int(np.argmax(((p - p[0]) ** 2).sum(1)))
        keep[[0, far]] = True
        stack = [(0, far), (far, len(p))]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            start, end = p[a], p[b % len(p)]
            along = end - start
            length = float(np.hypot(*along))
            rest = p[a + 1 : b] - start
            off = np.abs(along[0] * rest[:, 1] - along[1] * rest[:, 0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
            k = int(np.argmax(off))
            if off[k] > tolerance:
                keep[a + 1 + k] = True
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return [tuple(map(float, x)) for x in p[keep]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rings = [[[{"x": x, "y": y} for x, y in t] for ring in rs if len(t := thin([(q["x"], q["y"]) for q in ring])) >= 3] for rs in batch["rings"]]
            yield batch.assign(rings=rings)

    return polygons.mapInPandas(run, polygons.schema)
