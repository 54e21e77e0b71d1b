"""Adding to a table what it does not hold yet: as one step, and as a stream that stops when its folder is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.operators.ingest import with_row_ids


def appended(old: DataFrame, new: DataFrame, key: str, order: list[str], number: str = "id") -> DataFrame:
    """old and the rows of new whose key is not in old, numbered on from the largest number."""
    delta = new.join(old.select(key).distinct(), key, "left_anti")
    top = old.agg(F.coalesce(F.max(number), F.lit(0)).alias("top"))
    numbered = with_row_ids(delta, order, start=1).crossJoin(F.broadcast(top)).withColumn(number, F.col("row_id") + F.col("top")).drop("row_id", "top")
    return old.unionByName(numbered.select(*old.columns))


def same_schema(path_df: DataFrame, df: DataFrame) -> None:
    """An error unless both have the same columns and types in the same order."""
    a, b = ([(f.name, f.dataType) for f in d.schema.fields] for d in (path_df, df))
    if a != b:
        raise ValueError(f"columns differ: {a} and {b}")


def append_to(path: str, df: DataFrame) -> None:
    """Append Parquet after a check of the columns."""
    spark = df.sparkSession
    same_schema(spark.read.parquet(path), df)
    df.write.mode("append").parquet(path)


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, sep: str = ",") -> None:
    """Append what is new in a folder of delimited files to a Parquet table, each file once, and stop; to be called again."""
    rows = spark.readStream.schema(schema).option("header", True).option("sep", sep).csv(source)
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
