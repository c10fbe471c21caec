"""A planar hexagonal grid as column arithmetic: axial cells "q:r" of a given size (centre to corner) on metric coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT3 = math.sqrt(3.0)


def axial(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """The cell (q, r) that holds a point: fractional axial coordinates, rounded in cube space."""
    q, r = (x * (_ROOT3 / 3) - y / 3) / size, y * (2 / 3) / size
    s = -q - r
    half_up = lambda c: F.floor(c + 0.5)
    rq, rr, rs = half_up(q), half_up(r), half_up(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_off = (dq > dr) & (dq > ds)
    return F.when(q_off, -rr - rs).otherwise(rq).cast("long"), F.when(~q_off & (dr > ds), -rq - rs).otherwise(rr).cast("long")


def cell_id(q: Column, r: Column) -> Column:
    return F.concat_ws(":", q.cast("string"), r.cast("string"))


def cell_of(x: Column, y: Column, size: float) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), cell_id(*axial(x, y, size)))


def parts(cell: Column) -> tuple[Column, Column]:
    split = F.split(cell, ":")
    return split[0].cast("long"), split[1].cast("long")


def offsets(k: int) -> list[tuple[int, int]]:
    """The 1 + 3k(k + 1) cells within k steps of a cell."""
    return [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1)]


def grid_disk(cell: Column, k: int) -> Column:
    q, r = parts(cell)
    return F.when(cell.isNotNull(), F.array(*(cell_id(q + dq, r + dr) for dq, dr in offsets(k))))


def center(cell: Column, size: float) -> tuple[Column, Column]:
    q, r = parts(cell)
    return (q + r / 2) * (_ROOT3 * size), r * (1.5 * size)


def boundary(cell: Column, size: float) -> Column:
    """The six corners, array<struct<x, y>>, counter-clockwise."""
    x, y = center(cell, size)
    return F.array(*(F.struct((x + size * math.cos(math.pi * (2 * k + 1) / 6)).alias("x"), (y + size * math.sin(math.pi * (2 * k + 1) / 6)).alias("y")) for k in range(6)))


def boundary_wkt(cell: Column, size: float) -> Column:
    """The closed outline as text, x before y."""
    corners = F.transform(boundary(cell, size), lambda p: F.concat_ws(" ", F.format_string("%.6f", p["x"]), F.format_string("%.6f", p["y"])))
    return F.concat(F.lit("POLYGON(("), F.array_join(F.concat(corners, F.slice(corners, 1, 1)), ", "), F.lit("))"))


def cell_area(size: float) -> float:
    return 1.5 * _ROOT3 * size * size


def to_metric(lat: Column, lon: Column, meridian: float = -54.0, radius: float = 6_371_007.2) -> tuple[Column, Column]:
    """American polyconic metres on a sphere: exact along the central meridian, within about 0.5 % of an ellipsoid's."""
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    e, cot = lam * F.sin(phi), F.try_divide(F.cos(phi), F.sin(phi))
    flat = F.abs(phi) < 1e-9
    return F.when(flat, lam * radius).otherwise(cot * F.sin(e) * radius), F.when(flat, F.lit(0.0)).otherwise((phi + cot * (1 - F.cos(e))) * radius)


def register(spark: SparkSession, size: float) -> None:
    """SQL functions cell_of(x, y), row_mean(array), grid_disk(cell, k) and strips(rings, size), and the table function
    overlap_cells(rings, size, low, high): cell_id, area, holds_center of a polygon's cells in those rows of cells."""
    from pyspark.sql.functions import udtf

    from gridindex.operators.spatial import STRIP, OverlapCells

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION axial_q(x DOUBLE, y DOUBLE) RETURNS DOUBLE RETURN (x * {_ROOT3 / 3!r}D - y / 3) / {size!r}D")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION axial_r(x DOUBLE, y DOUBLE) RETURNS DOUBLE RETURN y * {2 / 3!r}D / {size!r}D")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cube_round(q DOUBLE, r DOUBLE) RETURNS STRING RETURN CASE "
        "WHEN abs(floor(q + .5) - q) > abs(floor(r + .5) - r) AND abs(floor(q + .5) - q) > abs(floor(-q - r + .5) + q + r) THEN concat_ws(':', -floor(r + .5) - floor(-q - r + .5), floor(r + .5)) "
        "WHEN abs(floor(r + .5) - r) > abs(floor(-q - r + .5) + q + r) THEN concat_ws(':', floor(q + .5), -floor(q + .5) - floor(-q - r + .5)) "
        "ELSE concat_ws(':', floor(q + .5), floor(r + .5)) END"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cell_of(x DOUBLE, y DOUBLE) RETURNS STRING RETURN CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN cube_round(axial_q(x, y), axial_r(x, y)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION row_mean(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN try_divide(aggregate(v, 0D, (s, x) -> s + coalesce(x, 0D)), size(filter(v, x -> x IS NOT NULL)))")
    near = "transform(filter(sequence(-k, k), b -> abs(a + b) <= k), b -> concat_ws(':', cast(split(cell, ':')[0] AS BIGINT) + a, cast(split(cell, ':')[1] AS BIGINT) + b))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION grid_disk(cell STRING, k INT) RETURNS ARRAY<STRING> RETURN CASE WHEN cell IS NOT NULL THEN flatten(transform(sequence(-k, k), a -> {near})) END")
    low, high = "floor((array_min(transform(rings[0], p -> p.y)) - size) / (1.5D * size))", "(ceil((array_max(transform(rings[0], p -> p.y)) + size) / (1.5D * size)) + 1)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strips(rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>, size DOUBLE) RETURNS ARRAY<STRUCT<low: BIGINT, high: BIGINT>> "
        f"RETURN transform(sequence({low}, {high}, {STRIP}), f -> struct(f AS low, least(f + {STRIP}, {high}) AS high))"
    )
    spark.udtf.register("overlap_cells", udtf(OverlapCells, returnType="cell_id string, area double, holds_center boolean"))


def exploded_disk(df: DataFrame, cell: str, k: int, name: str) -> DataFrame:
    """Distinct cells first, then their disks: the explosion never multiplies repeated rows."""
    return df.select(cell).distinct().select(cell, F.explode(grid_disk(F.col(cell), k)).alias(name))
