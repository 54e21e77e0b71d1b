"""Point sampling of rasters in long form: pixels by affine keys, nearest valid pixel, tiles, boxes, terrain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounding boxes (min lon, min lat, max lon, max lat) in the order in which they are tried.
CONTINENTS = [("af", -20.0, -36.0, 55.0, 38.0), ("as", 55.0, -12.0, 180.0, 82.0), ("au", 110.0, -56.0, 180.0, -10.0), ("eu", -25.0, 34.0, 60.0, 72.0), ("na", -170.0, 5.0, -50.0, 84.0), ("sa", -92.0, -56.0, -32.0, 15.0)]


def to_pixel(points: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """points with the row r and column c of a north-up raster with its upper left corner at (x0, y0)."""
    return points.withColumn("c", F.floor((F.col("lon") - x0) / dx).cast("long")).withColumn("r", F.floor((y0 - F.col("lat")) / dy).cast("long"))


def neighbours(radius: int, round_window: bool = False) -> list[tuple[int, int]]:
    """(dr, dc) without (0, 0): nearest first, then fewest steps, then by dr and dc; in a square or within the circle."""
    span = range(-radius, radius + 1)
    out = [(dr, dc) for dr in span for dc in span if (dr, dc) != (0, 0) and (not round_window or dr * dr + dc * dc <= radius * radius)]
    return sorted(out, key=lambda o: (o[0] ** 2 + o[1] ** 2, abs(o[0]) + abs(o[1]), o))


def sample(points: DataFrame, raster: DataFrame, radius: int = 0, round_window: bool = False) -> DataFrame:
    """points (id, r, c, ...) with value and found: 0 the pixel itself, k the k-th neighbour by order, null none. Where the raster has
    several layers and bands, points with layer and band columns look at their own; others need a raster of one.

    Points outside the raster and on missing pixels look at their neighbours; only those points are multiplied.
    """
    own = [k for k in ("layer", "band") if k in points.columns and k in raster.columns]
    cells = raster.where("value is not null").select(*own, "r", "c", "value")
    direct = points.join(cells, [*own, "r", "c"], "left")
    order = neighbours(radius, round_window)
    if not order:
        return direct.withColumn("found", F.when(F.col("value").isNotNull(), F.lit(0)))
    step = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(order))))
    missed = direct.where("value is null").select(*own, "id", "r", "c", step.alias("o")).select(*own, "id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "o.k")
    best = missed.join(cells, [*own, "r", "c"]).groupBy(*own, "id").agg(F.min(F.struct("k", "value")).alias("b"))
    return direct.join(best, [*own, "id"], "left").withColumn("found", F.when(F.col("value").isNotNull(), F.lit(0)).otherwise(F.col("b.k"))).withColumn("value", F.coalesce("value", "b.value")).drop("b")


def first_box(points: DataFrame, boxes: list[tuple] = CONTINENTS) -> DataFrame:
    """points with continent: the first box that holds the point, null if none. The boxes are a fixed list."""
    c = F.lit(None).cast("string")
    for name, x0, y0, x1, y1 in reversed(boxes):
        c = F.when(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1), F.lit(name)).otherwise(c)
    return points.withColumn("continent", c)


#: The layers of a manifest by which a point's continent is looked for, in turn.
LAYERS = (("dem",), ("flowacc", "flowdir"))


def manifest_boxes(manifest: dict, codes: list[str]) -> list[tuple]:
    """(code, min lon, min lat, max lon, max lat) in the order in which they are tried: of a manifest {"continents": {code: {"big": {layer:
    {"bounds_wgs84": [..]}}}}}, all continents by their elevation, then all by their flow layers. Absent layers are left out."""
    big = {c: manifest.get("continents", {}).get(c, {}).get("big", {}) for c in codes}
    return [(c, *big[c][layer]["bounds_wgs84"]) for group in LAYERS for c in codes for layer in group if big[c].get(layer)]


def tile_key(points: DataFrame, size: int = 5) -> DataFrame:
    x, y = (F.floor(F.col(c) / size).cast("long") * size for c in ("lon", "lat"))
    return points.withColumn("tile_key", F.concat(F.lit("x"), x.cast("string"), F.lit("_y"), y.cast("string")))


def tile_of_block(points: DataFrame, tiles: DataFrame, block: int) -> DataFrame:
    """points (id, r, c) with tile: the lowest-numbered rectangle (tile, r0, c0, r1, c1; ends exclusive) that holds the pixel. Rectangles
    are spread over the blocks that they touch, which makes it an equi-join."""
    rows = F.sequence(F.floor(F.col("r0") / block), F.floor((F.col("r1") - 1) / block))
    cols = F.sequence(F.floor(F.col("c0") / block), F.floor((F.col("c1") - 1) / block))
    spread = tiles.select("*", F.explode(rows).alias("br")).select("*", F.explode(cols).alias("bc"))
    keyed = points.withColumn("br", F.floor(F.col("r") / block)).withColumn("bc", F.floor(F.col("c") / block))
    inside = (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1"))
    best = keyed.join(spread, ["br", "bc"]).where(inside).groupBy("id").agg(F.min("tile").alias("tile"))
    return points.join(best, "id", "left")


def valid_ratio(raster: DataFrame, tile: int, least: float) -> DataFrame:
    """tr, tc, n, ratio of the tiles with at least the least share of valid pixels."""
    t = raster.groupBy(F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc")).agg(F.count("*").alias("n"), (F.count("value") / F.count("*")).alias("ratio"))
    return t.where(F.col("ratio") >= least)


def months(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the mean, sum, least and largest of twelve month columns, over those that have a value; null if none has."""
    v = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    n, total = F.size(v), F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return df.withColumns({"m_mean": F.when(n > 0, F.try_divide(total, n)), "m_sum": F.when(n > 0, total), "m_min": F.array_min(v), "m_max": F.array_max(v)})
