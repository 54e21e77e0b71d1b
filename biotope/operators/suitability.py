"""Envelope models of groups, scored on every cell of a lattice, and what the scores say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotope.functions.expr import normal_text, reliability, sharpened, trapezoid
from biotope.functions.shared import cut, few
from biotope.operators.ingest import FAMILIES, family

SHARP, FLOOR, CATEGORY_SHARE = 2.0, 0.02, 0.15
FACTOR_POWER, FACTOR_FLOOR = 0.35, 0.85
#: Groups whose models (a few hundred bytes a feature) are broadcast at once.
MODELS = 20_000
STRESS = {"strength": 0.45, "grace": 0.15, "extreme": 1.25, "power": 1.0}
#: Features (a name up to an underscore or its end) of which one side is a stress, with its axis and side.
STRESS_RULES = {
    "terraclimate_vpd": ("vpd", "high"),
    "terraclimate_pet": ("atmospheric_demand", "high"),
    "terraclimate_tmax": ("heat", "high"),
    "terraclimate_tmean": ("heat", "high"),
    "terraclimate_tmmx": ("heat", "high"),
    "terraclimate_ppt": ("moisture_supply", "low"),
    "terraclimate_aet": ("moisture_supply", "low"),
    "terraclimate_pdsi": ("moisture_balance", "low"),
}


def stress_rule(name: str) -> tuple[str, str] | None:
    """(axis, side) of a feature."""
    return next((rule for start, rule in STRESS_RULES.items() if name == start or name.startswith(f"{start}_")), None)


def stress_side(name: str) -> str | None:
    rule = stress_rule(name)
    return rule[1] if rule else None


def prior_weight(column: Column, families: DataFrame | None = None) -> Column:
    """What a feature without a weight of its own weighs: its family's share of all weights (families: family, share; a row a family),
    else the family's prior."""
    known = dict(FAMILIES)
    if families is not None:
        known |= {r[0]: r[1] for r in families.select("family", "share").collect() if r[1] is not None}  # a few families
    name = F.regexp_extract(column, "^(" + "|".join(f for f in FAMILIES if f != "other") + ")(?:_|$)", 1)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[F.when(name == "", "other").otherwise(name)], F.lit(known["other"]))


def models(profile: DataFrame, weights: DataFrame, least_valid: int = 1, families: DataFrame | None = None, least_features: int = 1, least_stress: int = 0) -> DataFrame:
    """A row a group and feature: min, q25, q75, max, w, whose sum over a group's features is 1, and stressed (whether the feature counts as a stress:
    it has a side, and the group has `least_stress` such features). Groups with fewer than `least_features` features have no rows."""
    j = profile.where(F.col("n_valid") >= least_valid).join(weights.select("column", "blended_weight"), "column", "left")
    w = F.when(F.col("blended_weight") > 0, F.col("blended_weight")).otherwise(prior_weight(F.col("column"), families))
    group = Window.partitionBy("grp")
    sided = F.col("column").rlike("^(" + "|".join(STRESS_RULES) + ")(_|$)")
    full = j.select("grp", "column", "min", "q25", "q75", "max", (w / F.sum(w).over(group)).alias("w"), F.count("*").over(group).alias("k"), (sided & (F.sum(sided.cast("int")).over(group) >= least_stress)).alias("stressed"))
    return full.where(F.col("k") >= least_features).drop("k")


def stress_bounds(lo: Column, q25: Column, q75: Column, hi: Column, side: str) -> tuple[Column, Column, Column]:
    """Where the stress begins, how far it is from there to the outer end, and the least distance that counts (a tenth of the range)."""
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    one, two = (F.greatest(a, F.least(b, q)) for q in (q25, q75))
    span = F.greatest(b - a, F.lit(1e-12))
    edge = F.when(one > two, (one + two) / 2).otherwise(two if side == "high" else one)
    start = F.least(b, edge + STRESS["grace"] * span) if side == "high" else F.greatest(a, edge - STRESS["grace"] * span)
    return start, (b - start) if side == "high" else (start - a), F.greatest(0.10 * span, F.lit(1e-12))


def stress_beyond(x: Column, start: Column, room: Column, least: Column, side: str, power: float = STRESS["power"]) -> Column:
    over = x - start if side == "high" else start - x
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), STRESS["extreme"] * over / F.greatest(room, least)))
    worst = F.lit(1 - STRESS["strength"])
    return F.when(x.isNull(), None).when(over >= room / STRESS["extreme"], worst).otherwise(1 - STRESS["strength"] * (1 - F.pow(1 - share, F.lit(power))))


def stress(x: Column, lo: Column, q25: Column, q75: Column, hi: Column, side: str | None, power: float = STRESS["power"]) -> Column:
    """1 up to a grace beyond the inner range on the side's end; from there down to 1 - strength, which it reaches before the outer end by the
    extreme multiplier; null without a side or value."""
    return F.lit(None).cast("double") if side is None else stress_beyond(x, *stress_bounds(lo, q25, q75, hi, side), side, power)


def at_least(score: Column, threshold: float | None) -> Column:
    """Scores below a threshold above 0 are 0; missing ones stay."""
    return F.when(score < threshold, F.lit(0.0)).otherwise(score) if threshold and threshold > 0 else score


def score(cells: DataFrame, envelopes: DataFrame, shares: DataFrame, category: str) -> DataFrame:
    """grp, id: core, stress_modifier, reliability, factor, adjusted. cells: id, features, category column. envelopes: models(). shares: grp,
    value, f (share of the category's values). The category weighs as much in the reliability as all features: 1 where the group has
    its value, 0 where not.

    Every cell meets every group: the models, a row a group and feature, are gathered to one row a group. Up to MODELS groups are broadcast and
    features are summed within the row; more groups go round in blocks of that many, each a pass over the cells. The models are written first,
    since they are read several times, and cells are dealt evenly to tasks, since a table of few row groups would be scored by as few.
    """
    envelopes = cut(envelopes)
    groups = envelopes.select("grp").distinct()
    if not few(groups, MODELS):
        parts = -(-groups.count() // MODELS) * 2
        out = None
        for k in range(parts):
            block = F.pmod(F.xxhash64("grp"), F.lit(parts)) == k  # about half of MODELS
            if envelopes.where(block).limit(1).count():
                one = _score(cells, envelopes.where(block), shares.where(block), category)
                out = one if out is None else out.unionByName(one)
        return out
    return _score(cells, envelopes, shares, category)


def _score(cells: DataFrame, envelopes: DataFrame, shares: DataFrame, category: str) -> DataFrame:
    names = sorted(r[0] for r in envelopes.select("column").distinct().collect() if r[0] in cells.columns)  # of the schema
    bounds = {n: stress_bounds(F.col("min"), F.col("q25"), F.col("q75"), F.col("max"), stress_side(n)) for n in names if stress_side(n)}  # once a group, not once a cell
    extra = {n: [F.when(F.col("stressed"), c).alias(k) for k, c in zip(("start", "room", "least"), b)] for n, b in bounds.items()}
    model = (F.max(F.when(F.col("column") == n, F.struct("min", "q25", "q75", "max", "w", *extra.get(n, ())))).alias(f"m_{n}") for n in names)
    packed = envelopes.where(F.col("column").isin(names)).groupBy("grp").agg(*model)
    values = shares.where("f > 0").groupBy("grp", normal_text(F.col("value")).alias("value")).agg(F.max("f").alias("f")).where("value <> ''")
    packed = packed.join(values.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("value", "f"))).alias("shares")), "grp", "left")
    own = normal_text(F.col(category).cast("string"))
    full = cells.select("id", *(F.col(n).cast("double").alias(n) for n in names), F.when(own != "", own).alias("cat"))
    spark = cells.sparkSession
    full = full.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)).crossJoin(F.broadcast(packed))

    def total(f, of: list[str] = names) -> Column:
        out = F.lit(0.0)
        for n in of:
            out = out + F.coalesce(f(n, F.col(f"m_{n}"), F.col(n)), F.lit(0.0))
        return out

    def env(m: Column) -> tuple:
        return m["min"], m["q25"], m["q75"], m["max"]

    sided = list(bounds)
    has = total(lambda n, m, x: F.when(x.isNotNull(), m["w"]))
    logs = total(lambda n, m, x: m["w"] * F.log(F.greatest(sharpened(trapezoid(x, *env(m)), SHARP, FLOOR), F.lit(1e-12))))
    rel = total(lambda n, m, x: m["w"] * reliability(x, *env(m)))
    hurt = total(lambda n, m, x: F.when(m["start"].isNotNull(), m["w"] * stress_beyond(x, m["start"], m["room"], m["least"], stress_side(n))), sided)
    hurt_w = total(lambda n, m, x: F.when(m["start"].isNotNull() & x.isNotNull(), m["w"]), sided)
    has_cat = F.col("cat").isNotNull() & F.col("shares").isNotNull()
    # a higher-order function keeps this projection out of whole-stage code, which would make it one method, too long for the JVM to compile
    match = F.col("shares")[F.transform(F.array("cat"), lambda v: v)[0]]
    one = full.select(
        "grp", "id", has.alias("has"), logs.alias("logs"), (rel + F.when(has_cat & match.isNotNull(), F.lit(1.0)).otherwise(0.0)).alias("rel"), hurt.alias("hurt"), hurt_w.alias("hurt_w"), F.coalesce(match, F.lit(0.0)).alias("f"), has_cat.alias("has_cat"),
    )
    numeric = F.when(F.col("has") > 0, F.exp(F.try_divide("logs", "has")))
    cat = sharpened(F.col("f"), SHARP, FLOOR)
    core = F.when(F.col("has_cat") & numeric.isNotNull(), F.exp((1 - CATEGORY_SHARE) * F.log(F.greatest(numeric, F.lit(1e-12))) + CATEGORY_SHARE * F.log(F.greatest(cat, F.lit(1e-12))))).otherwise(F.coalesce(numeric, F.when(F.col("has_cat"), cat)))
    out = one.select("grp", "id", core.alias("core"), F.coalesce(F.try_divide("hurt", "hurt_w"), F.lit(1.0)).alias("stress_modifier"), F.try_divide(F.col("rel"), F.col("has") + F.col("has_cat").cast("int")).alias("reliability"))
    out = out.withColumn("factor", sharpened(F.col("reliability"), FACTOR_POWER, FACTOR_FLOOR))
    return out.withColumn("adjusted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("core") * F.col("stress_modifier") * F.coalesce("factor", F.lit(1.0)))))


def summary(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.groupBy("grp").agg(
        F.count("adjusted").alias("n_cells"), F.avg("core").alias("mean_core"), F.avg("adjusted").alias("mean_adjusted"), F.max("adjusted").alias("max_adjusted"),
        F.count_if(F.col("adjusted") >= threshold).alias("n_suitable"), (F.count_if(F.col("adjusted") >= threshold) / F.count("adjusted")).alias("fraction_suitable"),
    )


def histogram(scores: DataFrame, value: str = "adjusted", bins: int = 512) -> DataFrame:
    """grp, bin, n and cdf: the share of a group's cells up to the bin."""
    b = F.least(F.floor(F.greatest(F.least(F.col(value), F.lit(1.0)), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    # missing values go after the count: a filter on the score before it would be pushed down and make every score twice
    h = scores.groupBy("grp", F.when(F.col(value).isNotNull(), b).alias("bin")).agg(F.count(value).alias("n")).where("n > 0")
    g = Window.partitionBy("grp")
    return h.withColumn("cdf", F.sum("n").over(g.orderBy("bin")) / F.sum("n").over(g))


def lower_tail(values: Column, n_groups: Column, tail: float = 0.25, power: float = 1.5) -> Column:
    """The mean of the k smallest values, k = max(1, ceil(n_groups * tail)), with weights rank ** -power; missing ones weigh nothing."""
    k = F.greatest(F.lit(1), F.ceil(n_groups * F.lit(tail)).cast("int"))
    low = F.slice(F.array_sort(F.filter(values, lambda v: v.isNotNull())), F.lit(1), k)
    ranked = F.transform(low, lambda v, i: F.struct(v.alias("v"), F.pow((i + 1).cast("double"), F.lit(-power)).alias("w")))
    w = F.aggregate(ranked, F.lit(0.0), lambda s, r: s + r["w"])
    return F.try_divide(F.aggregate(ranked, F.lit(0.0), lambda s, r: s + r["w"] * r["v"]), w)


def overall(scores: DataFrame, threshold: float = 0.5, alpha: float = 0.7, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per cell over the groups: best and worst score, the group of the best (ties: by name), joint support (alpha of the worst and the rest of
    the lower tail), richness (groups at the threshold or above), mean reliability."""
    a = scores.groupBy(*keys).agg(
        F.max("adjusted").alias("overall_adjusted"), F.min("adjusted").alias("overall_min"), F.min(F.struct((-F.col("adjusted")).alias("s"), "grp"))["grp"].alias("top_group"),
        F.count_if(F.col("adjusted") >= threshold).alias("richness"), F.avg("reliability").alias("reliability_mean"), F.count("*").alias("n"), F.collect_list("adjusted").alias("v"),
    )
    joint = alpha * F.col("overall_min") + (1 - alpha) * lower_tail(F.col("v"), F.col("n"))
    return a.withColumn("joint", F.greatest(F.lit(0.0), F.least(F.lit(1.0), joint))).drop("v", "n")


def by_rank(scores: DataFrame, members: DataFrame) -> DataFrame:
    """overall() over the groups of each rank value with more than one. members: grp, rank_value."""
    many = members.groupBy("rank_value").agg(F.countDistinct("grp").alias("k")).where("k > 1").select("rank_value")
    named = members.join(many, "rank_value").distinct()
    j = scores.join(F.broadcast(named) if few(named, MODELS) else named, "grp")
    return overall(j, keys=("rank_value", "id")).select("rank_value", "id", F.col("overall_min").alias("min_adjusted"), F.col("joint").alias("joint_adjusted"), "reliability_mean")
