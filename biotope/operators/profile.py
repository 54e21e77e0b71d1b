"""Profiles of groups: summaries of features, overlaps of groups, and the weight that each feature's signal earns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotope.functions.expr import interval_overlap, proximity
from biotope.functions.shared import cut
from biotope.operators.ingest import FAMILIES


def long(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """(grp,) column, family, value: a row for each row and feature. NaN is missing."""
    from biotope.operators.ingest import family

    item = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(family(c)).alias("family"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")) for c in columns)))
    keys = [F.coalesce(F.col(group).cast("string"), F.lit("NA")).alias("grp")] if group else []
    return df.select(*keys, item.alias("i")).select(*(["grp"] if group else []), "i.*")


def numeric(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: n_total, n_valid, n_missing, missing_fraction, min, q25, mean, median, q75, max, iqr, std (0 for one value)."""
    return _summed_up(values, keys).drop("var")


def _summed_up(values: DataFrame, keys: list[str]) -> DataFrame:
    """numeric(), and var: the population variance."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = values.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count("value").alias("n_valid"), F.min("value").alias("min"), q.alias("q"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_samp("value").alias("sd"), F.var_pop("value").alias("var"),
    )
    return s.select(
        *keys,
        "n_total",
        "n_valid",
        (F.col("n_total") - F.col("n_valid")).alias("n_missing"),
        ((F.col("n_total") - F.col("n_valid")) / F.col("n_total")).alias("missing_fraction"),
        "min",
        F.get("q", F.lit(0)).alias("q25"),
        "mean",
        F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(2)).alias("q75"),
        "max",
        (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"),
        F.when(F.col("n_valid") > 0, F.coalesce("sd", F.lit(0.0))).alias("std"),
        "var",
    )


def of_groups(values: DataFrame) -> DataFrame:
    """numeric() by column, family and grp, and var; written, so that whatever is made from it reads the values once."""
    return cut(_summed_up(values, ["column", "family", "grp"]))


def categories(df: DataFrame, columns: list[str], group: str | None = None, top: int = 50) -> DataFrame:
    """Per (group and) column the `top` most frequent values: count, and the share of the non-blank and of all rows."""
    item = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns)))
    keys = ["grp", "column"] if group else ["column"]
    own = [F.coalesce(F.col(group).cast("string"), F.lit("NA")).alias("grp")] if group else []
    rows = df.select(*own, item.alias("i")).select(*keys[:-1], "i.*")
    counted = rows.groupBy(*keys, F.when(F.col("value") != "", F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(*keys)
    valid = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).over(every)
    shares = counted.withColumn("n_total", F.sum("n").over(every)).withColumn("n_valid", valid).where("value is not null")
    ranked = shares.withColumn("rk", F.row_number().over(every.orderBy(F.desc("n"), "value"))).where(F.col("rk") <= top)
    return ranked.select(*keys, "value", "n", (F.col("n") / F.col("n_valid")).alias("fraction_of_non_null"), (F.col("n") / F.col("n_total")).alias("fraction_of_all_rows"))


def monthly(values: DataFrame, keys: list[str], least_months: int = 1) -> DataFrame:
    """Twelve rows per keys (of rows keys, month_num, value): the summary of each month, null where it has no value; only where `least_months`
    months have one."""
    s = numeric(values, [*keys, "month_num"]).select(*keys, "month_num", "n_valid", "min", "q25", "mean", "median", "q75", "max")
    all_months = s.select(*keys).distinct().withColumn("month_num", F.explode(F.sequence(F.lit(1), F.lit(12))))
    full = all_months.join(s, [*keys, "month_num"], "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    return full.withColumn("have", F.sum((F.col("n_valid") > 0).cast("int")).over(Window.partitionBy(*keys))).where(F.col("have") >= least_months).drop("have")


def anova(values: DataFrame) -> DataFrame:
    """Per column over its groups: n, groups, ss_between, ss_within, ss_total, eta2, f_stat. Two levels of partial sums, no second pass."""
    return _anova(values.where("value is not null").groupBy("column", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")))


def _anova(per: DataFrame) -> DataFrame:
    """anova() from a row a column and group: n, m (mean), v (population variance)."""
    g = per.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("ss_within"))
    b = per.join(g.select("column", "grand"), "column").groupBy("column").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("ss_between"))
    j = g.join(b, "column").withColumn("ss_total", F.col("ss_between") + F.col("ss_within"))
    f = F.try_divide(F.col("ss_between") / F.when(F.col("groups") > 1, F.col("groups") - 1), F.col("ss_within") / F.when(F.col("n") > F.col("groups"), F.col("n") - F.col("groups")))
    return j.select("column", "n", "groups", "ss_between", "ss_within", "ss_total", F.try_divide("ss_between", "ss_total").alias("eta2"), f.alias("f_stat"))


def overlap_pairs(profile: DataFrame, span: DataFrame) -> DataFrame:
    """Group pairs (group_a < group_b) by column: iqr_overlap, range_overlap, center_proximity, feature_overlap (.5, .3, .2 of those
    that exist). span: column, span of all values."""
    p = profile.where("n_valid > 0").select("column", "grp", "n_valid", "min", "q25", "median", "q75", "max")
    a, b = (p.select("column", *(F.col(c).alias(f"{c}_{s}") for c in p.columns[1:])) for s in "ab")
    j = a.join(b, "column").where("grp_a < grp_b").join(F.broadcast(span), "column")
    c = F.col
    return j.select(
        c("grp_a").alias("group_a"),
        c("grp_b").alias("group_b"),
        "column",
        F.least("n_valid_a", "n_valid_b").alias("n_valid_min_pair"),
        interval_overlap(c("q25_a"), c("q75_a"), c("q25_b"), c("q75_b")).alias("iqr_overlap"),
        interval_overlap(c("min_a"), c("max_a"), c("min_b"), c("max_b")).alias("range_overlap"),
        proximity(c("median_a"), c("median_b"), c("span")).alias("center_proximity"),
    ).withColumn("feature_overlap", 0.5 * c("iqr_overlap") + 0.3 * c("range_overlap") + 0.2 * c("center_proximity"))


def category_overlap(freq: DataFrame) -> DataFrame:
    """Group pairs by categorical column: the sum of the smaller shares, with what is beyond the listed values as one more value."""
    f = freq.select("column", "grp", "value", F.col("fraction_of_non_null").alias("f"))
    rest = f.groupBy("column", "grp").agg((1 - F.sum("f")).alias("f")).where("f > 1e-9").select("column", "grp", F.lit("__other__").alias("value"), "f")
    f = f.unionByName(rest)
    a, b = (f.select("column", "value", F.col("grp").alias(f"group_{s}"), F.col("f").alias(f"f{s}")) for s in "ab")
    return a.join(b, ["column", "value"]).where("group_a < group_b").groupBy("group_a", "group_b", "column").agg(F.sum(F.least("fa", "fb")).alias("overlap"))


def normalised(c: Column, over) -> Column:
    """Shares of the sum; negative and missing count 0; 0 if all do."""
    x = F.greatest(F.coalesce(F.nanvl(c, F.lit(None)), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(F.try_divide(x, F.sum(x).over(over)), F.lit(0.0))


def feature_weights(values: DataFrame, least_valid: int = 20) -> DataFrame:
    """column, family, eta2, signal_to_iqr, separation, blended_weight: how well each feature tells the groups apart."""
    return weights_of(of_groups(values), least_valid)


def weights_of(prof: DataFrame, least_valid: int = 20) -> DataFrame:
    """feature_weights() from the values' of_groups()."""
    per = prof.where("n_valid > 0").select("column", "grp", F.col("n_valid").alias("n"), F.col("mean").alias("m"), F.col("var").alias("v"))
    av = _anova(per).where((F.col("n") >= max(2, least_valid)) & (F.col("groups") >= 2))
    span = prof.groupBy("column").agg((F.max("max") - F.min("min")).alias("span"))
    groups = prof.where("n_valid > 0").groupBy("column", "family").agg(F.stddev_samp("median").alias("between"), F.percentile("iqr", F.lit(0.5)).alias("iqr_median")).join(span, "column")
    stable = F.greatest("iqr_median", F.greatest(0.05 * F.col("span"), F.lit(1e-9)))
    apart = overlap_pairs(prof, span).groupBy("column").agg((1 - F.avg("feature_overlap")).alias("separation"))
    one = Window.partitionBy()  # a row a feature
    j = av.join(groups, "column").join(apart, "column", "left").withColumn("signal_to_iqr", F.coalesce("between", F.lit(0.0)) / stable)
    prior = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))[F.col("family")]
    raw = (0.35 * normalised(F.col("eta2"), one) + 0.45 * normalised(F.col("separation"), one) + 0.20 * normalised(F.log1p("signal_to_iqr"), one)) * (0.5 + 0.5 * prior)
    return j.withColumn("raw", raw).select("column", "family", "eta2", "signal_to_iqr", "separation", normalised(F.col("raw"), one).alias("blended_weight"))


def family_weights(weights: DataFrame) -> DataFrame:
    """Per family: n_features, mean, median and sum of the weights, and the family's share of the means and of the sums."""
    w = F.col("blended_weight")
    f = weights.groupBy("family").agg(F.count("*").alias("n_features"), F.avg(w).alias("mean_weight"), F.percentile(w, F.lit(0.5)).alias("median_weight"), F.sum(w).alias("sum_weight"))
    every = Window.partitionBy()  # a row a family
    return f.withColumn("mean_share", normalised(F.col("mean_weight"), every)).withColumn("share", normalised(F.col("sum_weight"), every))


def overlap_matrix(pairs: DataFrame, weights: DataFrame, least_features: int = 1) -> DataFrame:
    """group_a, group_b, score: the weighted mean overlap (plain where all weights are 0), both ways round and 1 on the diagonal; null for
    pairs with too few features."""
    j = pairs.join(F.broadcast(weights.select("column", F.col("blended_weight").alias("w"))), "column", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    s = j.groupBy("group_a", "group_b").agg(F.sum(F.col("w") * F.col("feature_overlap")).alias("ws"), F.sum("w").alias("w"), F.avg("feature_overlap").alias("m"), F.countDistinct("column").alias("k"))
    one = s.select("group_a", "group_b", F.when(F.col("k") >= least_features, F.coalesce(F.try_divide("ws", "w"), F.col("m"))).alias("score"))
    both = one.unionByName(one.select(F.col("group_b").alias("group_a"), F.col("group_a").alias("group_b"), "score"))
    own = both.select("group_a").distinct().select("group_a", F.col("group_a").alias("group_b"), F.lit(1.0).alias("score"))
    return both.unionByName(own)


def redundancy(matrix: DataFrame, k: int = 3) -> DataFrame:
    """grp, weight: 1 / (1 + mean of the k largest overlaps with others), divided by the mean over groups."""
    order = Window.partitionBy("group_a").orderBy(F.desc("score"), "group_b")
    top = matrix.where("group_a <> group_b and score is not null").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    w = top.groupBy(F.col("group_a").alias("grp")).agg((1 / (1 + F.avg("score"))).alias("w"))
    return w.select("grp", (F.col("w") / F.avg("w").over(Window.partitionBy())).alias("weight"))


def category_matrix(overlaps: DataFrame) -> DataFrame:
    """group_a, group_b, score: the mean overlap over categorical columns, both ways round."""
    one = overlaps.groupBy("group_a", "group_b").agg(F.avg("overlap").alias("score"))
    return one.unionByName(one.select(F.col("group_b").alias("group_a"), F.col("group_a").alias("group_b"), "score"))


def blended(numeric_: DataFrame, categorical: DataFrame, share: float = 0.35) -> DataFrame:
    """group_a, group_b, score of two matrices: the categorical one counts `share`, the numeric one the rest, of those that have the pair;
    1 on the diagonal, null where neither has a score."""
    share = max(0.0, min(1.0, share))
    both = numeric_.select("group_a", "group_b", "score", F.lit(1 - share).alias("s")).unionByName(categorical.select("group_a", "group_b", "score", F.lit(share).alias("s")))
    known = F.when(F.col("score").isNotNull(), F.col("s"))
    m = both.where("group_a <> group_b").groupBy("group_a", "group_b").agg(F.try_divide(F.sum(F.col("score") * F.col("s")), F.nullif(F.sum(known), F.lit(0.0))).alias("score"))
    own = both.select("group_a").union(both.select("group_b")).distinct()
    return m.unionByName(own.select("group_a", F.col("group_a").alias("group_b"), F.lit(1.0).alias("score")))


def family_support(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """pair ("a | b", a before b), family, overlap: the weighted overlap of every pair of groups within each family of features."""
    j = pairs.join(weights.select("column", "family", F.col("blended_weight").alias("w")), "column")
    s = j.groupBy("group_a", "group_b", "family").agg(F.sum(F.col("w") * F.col("feature_overlap")).alias("ws"), F.sum("w").alias("w"), F.avg("feature_overlap").alias("m"))
    return s.select(F.concat_ws(" | ", "group_a", "group_b").alias("pair"), "family", F.coalesce(F.try_divide("ws", F.nullif("w", F.lit(0.0))), F.col("m")).alias("overlap"))
