"""The tree of names: nodes with counts, children, selectors, species under a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotope.functions.expr import normal_text, species_label

RANKS = ["kingdom", "phylum", "class", "ord", "family", "genus", "species"]
MISSING = "(missing)"


def _names() -> list[Column]:
    return [F.when(F.trim(F.coalesce(F.col(r), F.lit(""))) == "", MISSING).otherwise(F.trim(F.col(r))).alias(r) for r in RANKS]


def nodes(occ: DataFrame) -> DataFrame:
    """A row a node: rank_id (0 root, 1 .. 7), path (names joined by /), parent_path, name, obs_count. One roll-up counts all ranks."""
    counted = occ.select(*_names()).groupBy(*RANKS).agg(F.count("*").alias("n"))  # far fewer rows before the roll-up expands them
    rolled = counted.rollup(*RANKS).agg(F.sum("n").alias("obs_count"), F.grouping_id().alias("g"))
    depth = F.lit(7) - F.length(F.regexp_replace(F.bin("g"), "0", ""))
    parts = F.array(*RANKS)
    at = rolled.withColumn("rank_id", depth.cast("int"))
    path = F.array_join(F.slice(parts, F.lit(1), F.col("rank_id")), "/")
    parent = F.when(F.col("rank_id") > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.col("rank_id") - 1, F.lit(0))), "/"))
    name = F.when(F.col("rank_id") > 0, F.get(parts, F.col("rank_id") - 1)).otherwise("root")
    return at.select("rank_id", path.alias("path"), parent.alias("parent_path"), name.alias("name"), F.col("obs_count").cast("long"))


def children(tree: DataFrame, path: str, start: int, limit: int, by: str = "count_desc") -> DataFrame:
    """A page of a node's children, by name, count or count_desc (ties by name); position from 1."""
    order = {"name": ["name"], "count": ["obs_count", "name"], "count_desc": [F.desc("obs_count"), "name"]}[by]
    depth = 0 if path == "" else path.count("/") + 1
    mine = tree.where((F.col("parent_path") == path) & (F.col("rank_id") == depth + 1))
    first = mine.orderBy(*order).limit(start + limit)  # top-k before the one-task numbering
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("position") > start).select("position", "name", "rank_id", "obs_count")


def parse_selector(text: str) -> tuple[str | None, str]:
    """rank:name, rank=name or a bare name -> (rank or None, name). An unknown rank is an error."""
    for mark in (":", "="):
        rank, found, name = text.partition(mark)
        if found:
            rank = {"order": "ord"}.get(rank.strip().lower(), rank.strip().lower())
            if rank not in RANKS:
                raise ValueError(f"unknown rank in {text!r}")
            return rank, name.strip()
    return None, text.strip()


def matches(selectors: list[str]) -> Column:
    """Whether a row has a name that a selector means, at its rank or at any."""
    found = F.lit(False)
    for rank, name in map(parse_selector, selectors):
        for r in [rank] if rank else RANKS:
            same = normal_text(F.col(r)) == " ".join(name.split()).lower()
            if r == "species":
                same = same | (normal_text(species_label(F.col("genus"), F.col("species"))) == " ".join(name.split()).lower())
            found = found | F.coalesce(same, F.lit(False))
    return found


def species_under(occ: DataFrame, include: list[str], exclude: list[str] = (), least: int = 1, most: int | None = None) -> DataFrame:
    """Species (all seven names, obs_count) with a name in include and none in exclude, and at least `least` rows; most frequent first."""
    counted = occ.select(*_names()).groupBy(*RANKS).agg(F.count("*").alias("obs_count")).where(F.col("obs_count") >= least)
    kept = counted.where(matches(include) & ~matches(list(exclude))) if include else counted.where(~matches(list(exclude)))
    return kept.orderBy(F.desc("obs_count"), *RANKS).limit(most) if most else kept


def under(occ: DataFrame, paths: list[str]) -> DataFrame:
    """Per node (path of names; repeated ones count once): n_species and n_rows below it, itself included."""
    counted = occ.select(*_names()).groupBy(*RANKS).agg(F.count("*").alias("n"))
    nodes_ = counted.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(RANKS))), lambda k: F.array_join(F.slice(F.array(*RANKS), F.lit(1), k), "/"))).alias("path"))
    return nodes_.where(F.col("path").isin(*dict.fromkeys(paths))).groupBy("path").agg(F.count("*").alias("n_species"), F.sum("n").alias("n_rows"))


def group_meta(occ: DataFrame, group: str = "grp", order: str = "row_id") -> DataFrame:
    """Per group (null is NA): n, and the first non-null name of each rank by row."""
    firsts = [F.min_by(r, F.when(F.col(r).isNotNull(), F.col(order))).alias(r) for r in RANKS]
    return occ.groupBy(F.coalesce(F.col(group), F.lit("NA")).alias("grp")).agg(F.count("*").alias("n"), *firsts)


def species_page(occ: DataFrame, species: str, start: int, limit: int) -> DataFrame:
    """Rows start .. start + limit of a species in the order of row_id, with their position from 0."""
    first = occ.where(F.col("species") == species).orderBy("row_id").limit(start + limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy("row_id")) - 1).where(F.col("position") >= start)
