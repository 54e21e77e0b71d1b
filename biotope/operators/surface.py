"""Regular lattices: box filters, smoothing, hole filling, coarsening, steps and edges, counts of occurrences per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def densify(cells: DataFrame) -> DataFrame:
    """ix, iy, value for every place between the least and largest index; missing cells are null rows."""
    box = cells.agg(F.min("ix").alias("a"), F.max("ix").alias("b"), F.min("iy").alias("c"), F.max("iy").alias("d"))
    columns = box.select(F.explode(F.sequence("a", "b")).alias("ix"), "c", "d").repartition("ix")  # a row a column; the cells are made by many tasks
    return columns.select("ix", F.explode(F.sequence("c", "d")).alias("iy")).join(cells.select("ix", "iy", "value", F.lit(True).alias("own")), ["ix", "iy"], "left")


def box_filter(cells: DataFrame, r: int = 1) -> DataFrame:
    """ix, iy, value, blur, near: the mean and number of the values within r steps each way. Two window passes, over rows and columns,
    instead of (2 r + 1) ** 2 neighbours a cell. Missing cells of the lattice are filled in for the passes: they carry sums."""
    row = Window.partitionBy("iy").orderBy("ix").rangeBetween(-r, r)
    col = Window.partitionBy("ix").orderBy("iy").rangeBetween(-r, r)
    one = densify(cells).withColumn("s1", F.sum("value").over(row)).withColumn("n1", F.count("value").over(row))
    two = one.withColumn("s2", F.sum("s1").over(col)).withColumn("near", F.sum("n1").over(col))
    return two.where("own").select("ix", "iy", "value", F.when(F.col("near") > 0, F.col("s2") / F.col("near")).alias("blur"), "near")


def smooth_and_sharpen(cells: DataFrame, r: int = 1, amount: float = 0.6) -> DataFrame:
    """The blurred value, and the value moved away from it by `amount`, within 0..1; null where the cell has no value."""
    f = box_filter(cells, r)
    sharp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") + amount * (F.col("value") - F.col("blur"))))
    return f.select("ix", "iy", "value", F.when(F.col("value").isNotNull(), F.col("blur")).alias("value_smooth"), F.when(F.col("value").isNotNull(), sharp).alias("value_sharpen"))


def fill_holes(cells: DataFrame, least: int = 5, passes: int = 1, r: int = 1) -> DataFrame:
    """Missing cells with at least `least` values around them get their mean; `passes` times."""
    dense = densify(cells).drop("own")
    for _ in range(passes):
        dense = box_filter(dense, r).select("ix", "iy", F.coalesce("value", F.when(F.col("near") >= least, F.col("blur"))).alias("value"))
    return dense


def coarsen(cells: DataFrame, factor: int) -> DataFrame:
    return cells.groupBy(F.floor(F.col("ix") / factor).alias("bx"), F.floor(F.col("iy") / factor).alias("by")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def axis(points: DataFrame, name: str, digits: int = 6) -> DataFrame:
    """value, low and high edge of each distinct coordinate (midpoints; the outer edges as far out as the inner ones), and the median step.

    The distinct coordinates of a lattice are few: as many as it has columns or rows.
    """
    v = points.select(F.round(name, digits).alias("v")).distinct()
    w = Window.orderBy("v")
    n = v.withColumn("before", F.lag("v").over(w)).withColumn("after", F.lead("v").over(w))
    step = n.agg(F.percentile(F.col("after") - F.col("v"), F.lit(0.5)).alias("step"))
    half_before, half_after = (F.col("v") - F.col("before")) / 2, (F.col("after") - F.col("v")) / 2
    return n.crossJoin(F.broadcast(step)).select("v", (F.col("v") - F.coalesce(half_before, half_after)).alias("low"), (F.col("v") + F.coalesce(half_after, half_before)).alias("high"), "step")


def regular(points: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """One row a place: lon, lat rounded, and the mean of the value."""
    return points.groupBy(F.round("lon", digits).alias("lon"), F.round("lat", digits).alias("lat")).agg(F.avg(value).alias("value"))


def nearest_cell(occ: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """Every occurrence (row_id) with the id of the nearest cell within radius (ties: smallest id), null if none.

    Both sides go into squares of the radius; an occurrence looks into its own and the eight around it, so it is an equi-join.
    """
    def square(c: str):
        return F.floor(F.col(c) / radius).cast("long")

    near = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    asked = occ.select("row_id", "lon", "lat", near.alias("o")).select("row_id", "lon", "lat", (square("lon") + F.col("o.dx")).alias("sx"), (square("lat") + F.col("o.dy")).alias("sy"))
    there = cells.select(F.col("id").alias("cell"), F.col("lon").alias("clon"), F.col("lat").alias("clat"), square("lon").alias("sx"), square("lat").alias("sy"))
    d2 = F.pow(F.col("lon") - F.col("clon"), 2) + F.pow(F.col("lat") - F.col("clat"), 2)
    hit = asked.join(there, ["sx", "sy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    best = hit.groupBy("row_id").agg(F.min(F.struct("d2", "cell"))["cell"].alias("cell"))
    return occ.join(best, "row_id", "left")


def cell_counts(mapped: DataFrame, cells: DataFrame) -> DataFrame:
    """id, n: occurrences per cell, 0 where none is."""
    n = mapped.where("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))
    return cells.select("id").join(n.withColumnRenamed("cell", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def cell_counts_by_group(mapped: DataFrame, group: str = "grp") -> DataFrame:
    """grp, id, n: occurrences per group and cell that has any."""
    return mapped.where("cell is not null").groupBy(F.col(group).alias("grp"), F.col("cell").alias("id")).agg(F.count("*").alias("n"))


def mapping_summary(mapped: DataFrame, group: str = "grp") -> DataFrame:
    m = F.count("cell")
    return mapped.groupBy(group).agg(F.count("*").alias("n_selected"), m.alias("n_mapped"), (F.count("*") - m).alias("n_unmapped"), (m / F.count("*")).alias("fraction_mapped"))
