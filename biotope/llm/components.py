"""Connected components of a table of links, by smallest label and pointer jumping; only a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). id, component (the smallest id that can be reached), for every id that has a link.

    Every round writes its labels in the shared folder. Null ends and self links are left out; repeated links change nothing.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("now"))
        # a label's own label from the round before: paths halve
        up = labels.select(F.col("id").alias("now"), F.col("component").alias("up"))
        new = cut(step.join(up, "now", "left").select("id", "old", F.least("now", "up").alias("component")), "labels")
        changed = new.where("old <> component").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(edges)
            return labels.select("id", "component")
