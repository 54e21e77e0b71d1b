"""Which groups share map cells: presence, pairs, measures, ranked associates, one list over several grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotope.functions.expr import association, mercator_cell, valid_lat_lon, within_uncertainty

OFFSETS = {"exact": [(0, 0)], "moore1": [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]}


def presence(occ: DataFrame, variants: list[tuple[float, float, float]], species: str = "species", adjacency: str = "exact", uncertainty: float = 0.0) -> DataFrame:
    """scale, px, py, cx, cy, sid: the distinct cells of each species on every grid (scale in metres, shift as a share of a cell)."""
    rows = occ.where(valid_lat_lon(F.col("lat"), F.col("lon")) & F.col(species).isNotNull())
    cells = []
    for scale, px, py in variants:
        cx, cy = mercator_cell(F.col("lon"), F.col("lat"), scale, px, py)
        cell = F.struct(F.lit(float(scale)).alias("scale"), F.lit(float(px)).alias("px"), F.lit(float(py)).alias("py"), cx.alias("cx"), cy.alias("cy"))
        cells.append(F.when(within_uncertainty(F.col("unc"), scale, uncertainty), cell))
    spread = rows.select(F.col(species).alias("sid"), F.explode(F.array(*cells)).alias("v")).where("v is not null").select("sid", "v.*").distinct()
    around = OFFSETS[adjacency]
    if len(around) > 1:
        off = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around)))
        spread = spread.withColumn("o", off).select("sid", "scale", "px", "py", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")).distinct()
    return spread


def variant_key(adjacency: str = "exact") -> Column:
    """Name of a grid: its scale, shift and adjacency."""
    part = [F.regexp_replace(F.round(c, 4).cast("decimal(10,4)").cast("string"), r"\.?0+$", "") for c in ("px", "py")]
    return F.concat(F.col("scale").cast("long").cast("string"), F.lit("m_x"), part[0], F.lit("_y"), part[1], F.lit(f"_{adjacency}"))


def totals(found: DataFrame, max_cell_species: int = 150, min_shared: int = 2) -> DataFrame:
    """Per grid: cells, skipped_cells (with more species than the cap), kept_records, and pairs (a < b that share enough cells). One count a cell."""
    per = found.groupBy(*CELL).agg(F.count("*").alias("rich"))
    cells = per.groupBy(*GRID).agg(F.count_if(F.col("rich") <= max_cell_species).alias("cells"), F.count_if(F.col("rich") > max_cell_species).alias("skipped_cells"), F.coalesce(F.sum(F.when(F.col("rich") <= max_cell_species, F.col("rich"))), F.lit(0)).alias("kept_records"))
    emitted = pairs(usable(found, max_cell_species), min_shared).groupBy(*GRID).agg(F.count("*").alias("pairs"))
    return cells.join(emitted, GRID, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


GRID = ["scale", "px", "py"]
CELL = [*GRID, "cx", "cy"]


def usable(found: DataFrame, max_cell_species: int = 150) -> DataFrame:
    """Presence without the cells that more species share; they count in no total."""
    return found.withColumn("rich", F.count("*").over(Window.partitionBy(*CELL))).where(F.col("rich") <= max_cell_species).drop("rich")


def pairs(found: DataFrame, min_shared: int = 2) -> DataFrame:
    """a < b, and the cells that they share. The cap on a cell's species bounds its pairs."""
    one, two = found.withColumnRenamed("sid", "a"), found.withColumnRenamed("sid", "b")
    return one.join(two, CELL).where("a < b").groupBy(*GRID, "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


def associates(found: DataFrame, k: int = 20, min_shared: int = 2, min_cells: int = 2, min_lift: float = 1.0, min_conditional: float = 0.0, min_npmi: float = 0.0) -> DataFrame:
    """Per grid and species the k best associates: all measures and rank (score, shared, lift, then name)."""
    both = pairs(found, min_shared)
    both = both.unionByName(both.select(*GRID, F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    cells = found.groupBy(*GRID, "sid").agg(F.count("*").alias("n"))
    totals = found.groupBy(*GRID).agg(F.countDistinct("cx", "cy").alias("t"))
    full = both.join(cells.select(*GRID, F.col("sid").alias("a"), F.col("n").alias("a_cells")), [*GRID, "a"]).join(cells.select(*GRID, F.col("sid").alias("b"), F.col("n").alias("b_cells")), [*GRID, "b"]).join(F.broadcast(totals), GRID)
    scored = full.select("*", *(c.alias(n) for n, c in association(F.col("shared"), F.col("a_cells"), F.col("b_cells"), F.col("t")).items()))
    kept = scored.where((F.col("a_cells") >= min_cells) & (F.col("npmi") >= min_npmi))
    if min_lift:
        kept = kept.where(F.col("lift") >= min_lift)
    if min_conditional:
        kept = kept.where(F.col("p_b_given_a") >= min_conditional)
    best = Window.partitionBy(*GRID, "a").orderBy(F.desc("score"), F.desc("shared"), F.desc("lift"), "b")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def collapse(ranked: DataFrame, k: int = 20) -> DataFrame:
    """One row a pair over all grids: a, b, n_variants, scales, variants, best_score, best_shared, best_lift, mean_score, predictor_score, rank."""
    rounded = ranked.withColumn("score", F.round("score", 8)).withColumn("lift", F.round("lift", 8))
    best = F.max_by(F.struct("score", "shared", "lift", "scale"), F.struct("score", "shared", -F.col("scale"), -F.col("px"), -F.col("py")))
    one = rounded.groupBy("a", "b").agg(F.count("*").alias("n_variants"), F.array_sort(F.collect_set("scale")).alias("s"), F.array_join(F.array_sort(F.collect_set(variant_key())), "|").alias("variants"), best.alias("best"), F.avg("score").alias("mean_score"))
    more = 1 + F.least(F.lit(0.5), 0.15 * F.greatest(F.lit(0), F.size("s") - 1))
    one = one.select("a", "b", "n_variants", F.array_join(F.transform("s", lambda x: x.cast("long").cast("string")), "|").alias("scales"), "variants", F.col("best.score").alias("best_score"), F.col("best.shared").alias("best_shared"), F.col("best.lift").alias("best_lift"), "mean_score", ((0.7 * F.col("best.score") + 0.3 * F.col("mean_score")) * more).alias("predictor_score"))
    order = Window.partitionBy("a").orderBy(F.desc(F.round("predictor_score", 8)), F.desc("best_shared"), F.desc("best_lift"), "b")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
