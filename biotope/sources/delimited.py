"""Delimited text: which delimiter a file has, its columns, its rows, its points; and files per species."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.functions.expr import number, path_part

#: Delimiters in the order that decides between equal counts.
DELIMITERS = (",", "\t", ";", "|")
#: Header names that mean a point's id and coordinates.
ALIASES = {"id": ("id", "pid", "pointid", "point_id", "name"), "lon": ("lon", "longitude", "long", "x", "decimallongitude"), "lat": ("lat", "latitude", "y", "decimallatitude")}


def delimiter(header: str) -> str:
    """The most frequent delimiter outside quotes; a comma if there is none."""
    bare = re.sub(r'"(?:[^"]|"")*"?', "", header)
    best = max(DELIMITERS, key=bare.count)  # the first of equal ones
    return best if bare.count(best) else ","


def split_header(line: str, sep: str) -> list[str]:
    """Names of a header; a quote counts only where a field begins, and is written twice within."""
    fields, at = [], 0
    while at <= len(line):
        if line[at : at + 1] == '"':
            end = at + 1
            while end < len(line) and (line[end] != '"' or line[end : end + 2] == '""'):
                end += 2 if line[end : end + 2] == '""' else 1
            tail = line.find(sep, end)
            tail = len(line) if tail < 0 else tail
            fields.append(line[at + 1 : end].replace('""', '"') + line[end + 1 : tail])
        else:
            tail = line.find(sep, at)
            tail = len(line) if tail < 0 else tail
            fields.append(line[at:tail])
        at = tail + len(sep)
    return fields


def read(spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool = True) -> DataFrame:
    """A table of text columns with the file's own names; quoted fields may hold delimiters and, with multiline, line breaks (a file is
    then read by one task; without, large files are split). columns: only these, whatever their case; unknown ones are left out."""
    from biotope.operators.ingest import project

    first = spark.read.text(path).limit(1).collect()
    sep = delimiter(first[0][0].lstrip("﻿") if first else "")
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multiline).csv(path)
    return project(df, columns) if columns else df


def read_points(spark: SparkSession, path: str, keep_bad: bool = True) -> DataFrame:
    """id, lon, lat by any of their usual names; coordinates that are no numbers are null, or their rows dropped. Without an id column the
    id is empty."""
    df = read(spark, path)
    names = {c.strip().lower(): c for c in df.columns}

    def column(kind: str):
        found = next((names[a] for a in ALIASES[kind] if a in names), None)
        if found is None and kind != "id":
            raise ValueError(f"no column for {kind} among {df.columns}")
        return F.col(f"`{found}`") if found else F.lit("")

    points = df.select(column("id").alias("id"), number(column("lon")).alias("lon"), number(column("lat")).alias("lat"))
    return points if keep_bad else points.where("lon is not null and lat is not null")


def write_by_species(df: DataFrame, path: str, ranks: list[str], sep: str = ",") -> None:
    """Delimited files in a folder for each value of the ranks."""
    out = df
    for r in ranks:
        out = out.withColumn(f"{r}_folder", path_part(F.col(r)))
    folders = [f"{r}_folder" for r in ranks]
    out.repartition(*folders).write.partitionBy(*folders).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
