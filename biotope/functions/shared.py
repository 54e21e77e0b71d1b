"""Tables written in the shared folder, where lineage ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet below spark.checkpoint.dir (where that is unset, in local mode only, below /tmp/checkpoints) and read it back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base or 'file:///tmp/checkpoints'}/{uuid.uuid4().hex}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> bool:
    """Whether a table has `most` rows at most, so that it may be broadcast."""
    return df.limit(most + 1).count() <= most
