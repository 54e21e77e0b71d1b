"""Lattices, polygons and spatial blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lattice(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, step: float) -> DataFrame:
    """ix, iy, x, y: points in the middle of the cells of a grid that is aligned to multiples of step."""
    sx, sy = math.floor(x0 / step) * step + step / 2, math.floor(y0 / step) * step + step / 2
    nx, ny = max(0, math.ceil((x1 - sx) / step)), max(0, math.ceil((y1 - sy) / step))
    at = spark.range(nx * ny)
    ix, iy = F.col("id") % max(1, nx), F.floor(F.col("id") / max(1, nx))
    return at.select(ix.alias("ix"), iy.alias("iy"), (sx + ix * step).alias("x"), (sy + iy * step).alias("y"))


def inside(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """The points (x, y) in a polygon: an odd number of its edges lies to their right. The ring is a literal list."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        if ay == by:
            continue
        spans = (F.lit(ay) > F.col("y")) != (F.lit(by) > F.col("y"))
        crossings = crossings + (spans & (F.col("x") < (bx - ax) * (F.col("y") - ay) / (by - ay) + ax)).cast("int")
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return points.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))).where(crossings % 2 == 1)


def block(size: float, x: str = "lon", y: str = "lat"):
    return F.floor(F.col(x) / size).cast("long").alias("bx"), F.floor(F.col(y) / size).cast("long").alias("by")


def outside_buffer(candidates: DataFrame, positives: DataFrame, size: float, buffer: int) -> DataFrame:
    """Candidates (lon, lat) that are in no block within `buffer` blocks of a positive's."""
    taken = positives.select(*block(size)).distinct()
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-buffer, buffer + 1) for dy in range(-buffer, buffer + 1))))
    taken = taken.withColumn("o", steps).select((F.col("bx") + F.col("o.dx")).alias("bx"), (F.col("by") + F.col("o.dy")).alias("by")).distinct()
    return candidates.select("*", *block(size)).join(taken, ["bx", "by"], "left_anti").drop("bx", "by")
