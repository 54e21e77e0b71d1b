"""Descriptions of gridded layers: mosaic files, lists of tiles, names of datasets and years, boundaries, lookup tables, run records."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.functions.expr import number

DEPTHS = ("0-5cm", "5-15cm", "15-30cm")
STATS = ("mean", "Q0.05", "Q0.5", "Q0.95", "uncertainty")
_RECT = "struct<_xOff:double,_yOff:double,_xSize:double,_ySize:double>"


def mosaic_sources(spark: SparkSession, path: str) -> DataFrame:
    """Of a mosaic's XML: place (order in the file), band, file, and source and target rectangles (s_/d_ x, y, w, h)."""
    source = f"struct<SourceFilename:struct<_VALUE:string,_relativeToVRT:string>,SrcRect:{_RECT},DstRect:{_RECT}>"
    df = spark.read.format("xml").option("rowTag", "VRTRasterBand").schema(f"_band int, SimpleSource array<{source}>, ComplexSource array<{source}>").load(path)
    every = F.concat(F.coalesce("SimpleSource", F.array().cast(f"array<{source}>")), F.coalesce("ComplexSource", F.array().cast(f"array<{source}>")))
    one = df.select(F.col("_band").alias("band"), F.posexplode(every).alias("place", "s"))
    rects = [F.col(f"s.{r}._{c}").alias(f"{k}_{n}") for k, r in (("s", "SrcRect"), ("d", "DstRect")) for n, c in (("x", "xOff"), ("y", "yOff"), ("w", "xSize"), ("h", "ySize"))]
    return one.select("band", "place", F.col("s.SourceFilename._VALUE").alias("file"), *rects)


def source_pixel(points: DataFrame, sources: DataFrame, block: int = 256) -> DataFrame:
    """points (id, r, c) with file and source pixel sr, sc: the first source by place whose target rectangle holds the pixel."""
    from biotope.operators.raster import tile_of_block

    tiles = sources.select(F.col("place").cast("long").alias("tile"), F.col("d_y").cast("long").alias("r0"), F.col("d_x").cast("long").alias("c0"), (F.col("d_y") + F.col("d_h")).cast("long").alias("r1"), (F.col("d_x") + F.col("d_w")).cast("long").alias("c1"))
    placed = tile_of_block(points, tiles, block).withColumnRenamed("tile", "place")
    j = placed.join(sources.drop("band").withColumn("place", F.col("place").cast("long")), "place", "left")
    at = {k: (F.col(f"s_{o}") + F.floor((F.col(p) - F.col(f"d_{o}")) * F.col(f"s_{s}") / F.col(f"d_{s}"))).cast("long") for k, p, o, s in (("sr", "r", "y", "h"), ("sc", "c", "x", "w"))}
    return j.select("id", "r", "c", "file", at["sr"].alias("sr"), at["sc"].alias("sc"))


def tiles(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """path, layer, x, y of files named <layer>_x<..>_y<..>; of a plain file and one with _cog, the latter. Only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    parts = files.select("path", name.alias("name"), name.endswith("_cog").alias("cog")).withColumn("stem", F.regexp_replace("name", "_cog$", ""))
    grammar = r"^(.*)_x(-?\d+)_y(-?\d+)$"
    keyed = parts.where(F.col("stem").rlike(grammar)).select("path", "cog", F.regexp_extract("stem", grammar, 1).alias("layer"), F.regexp_extract("stem", grammar, 2).cast("int").alias("x"), F.regexp_extract("stem", grammar, 3).cast("int").alias("y"))
    return keyed.groupBy("layer", "x", "y").agg(F.max_by("path", F.struct("cog", "path")).alias("path"))


def dataset_name(name: str) -> tuple[str, str, str] | None:
    """<property>_<depth>_<statistic> -> its parts."""
    m = re.fullmatch(r"(.+)_(\d+-\d+cm)_([^_]+)", name)
    return m.groups() if m else None


def dataset_names(properties: list[str], depths: list[str] = DEPTHS, stat: str = "mean") -> list[str]:
    return list(dict.fromkeys(f"{p}_{d}_{stat}" for p in properties for d in depths))


def years(spec: str, latest: int) -> list[int]:
    """latest, 2019, 2015-2019, 2019-2015 or a list of these, each year once in the order given."""
    out: list[int] = []
    for part in re.split(r"[,\s]+", spec.strip()):
        if part.lower() == "latest":
            out.append(latest)
        elif m := re.fullmatch(r"(\d{4})-(\d{4})", part):
            a, b = map(int, m.groups())
            out += range(a, b + (1 if a <= b else -1), 1 if a <= b else -1)
        elif re.fullmatch(r"\d{4}", part):
            out.append(int(part))
        elif part:
            raise ValueError(f"no year: {part!r}")
    return list(dict.fromkeys(out))


def lookup(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table by an integer key; rows whose key is none are left out."""
    from biotope.sources.delimited import read

    df = read(spark, path)
    return df.withColumn(key, number(F.col(key)).cast("int")).where(F.col(key).isNotNull())


def rings(spark: SparkSession, path: str) -> DataFrame:
    """feature, ring, seq, x, y of the polygons in a GeoJSON file."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = "array<array<array<double>>>"
    shape = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    one = text.select(F.posexplode(F.from_json("value", shape)["features"]).alias("feature", "f"))
    polygon = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", pairs))).otherwise(F.from_json("f.geometry.coordinates", f"array<{pairs}>"))
    flat = one.select("feature", F.posexplode(F.flatten(polygon)).alias("ring", "points"))
    return flat.select("feature", "ring", F.posexplode("points").alias("seq", "p")).select("feature", "ring", "seq", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def inside_rings(points: DataFrame, ring_table: DataFrame) -> DataFrame:
    """The points (id, x, y) within any feature: edges that cross the point's level to its right are counted, odd is inside. Edges meet points
    by unit band of y, so it is an equi-join."""
    from pyspark.sql import Window

    w = Window.partitionBy("feature", "ring").orderBy("seq")
    e = ring_table.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("y2 is not null and y <> y2")
    spread = e.select("feature", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", F.explode(F.sequence(F.floor(F.least("y", "y2")), F.floor(F.greatest("y", "y2")))).alias("band"))
    j = points.withColumn("band", F.floor("y")).join(spread, "band")
    right = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = j.where(right).groupBy("id", "feature").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id").distinct()
    return points.join(odd, "id", "left_semi")


def write_record(path: str, record: dict) -> None:
    """A run's settings as JSON, beside its output."""
    with open(path, "w") as f:
        json.dump(record, f, indent=2, sort_keys=True)
