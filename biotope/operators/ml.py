"""Samples, folds, metrics, thresholds and classifiers for presence models."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotope.functions.expr import normal_text


def hash_order(*cols: str, seed: int = 42) -> Column:
    """An order that depends on the values only, and is the same in any engine with MD5."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in cols), F.lit(str(seed))))


def capped(df: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most `most` rows, each label with its share (at least one row), in hash order. The shares come from counts; the window is
    per label, and its limit is pushed below the shuffle."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    quota = counts.withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(most) * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("int"))).select(label, "quota")
    ranked = df.withColumn("rk", F.row_number().over(Window.partitionBy(label).orderBy(hash_order(key), key)))
    return ranked.where(F.col("rk") <= most).join(F.broadcast(quota), label).where(F.col("rk") <= F.col("quota")).drop("rk", "quota")


def one_per_place(df: DataFrame, keys: list[str], order: str, digits: int = 6) -> DataFrame:
    """The first row by `order` of each rounded place (and keys)."""
    first = F.min_by(F.struct(*df.columns), F.col(order))
    return df.groupBy(*keys, F.round("lon", digits).alias("_x"), F.round("lat", digits).alias("_y")).agg(first.alias("s")).select("s.*")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row a class
    return c.select("label", "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """roc_auc, pr_auc (average precision), logloss, brier, accuracy, balanced_accuracy, precision, recall, f1 of rows (y 0/1, p).

    Rows are first counted per distinct score (rounded to 6 places), so the one ordered window runs over scores, not over rows.
    """
    s = scored.select(F.col("y").cast("long").alias("y"), F.round("p", 6).alias("s"), F.col("p").cast("double").alias("p"))
    e = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    hat = (F.col("p") >= threshold).cast("long")
    flat = s.agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.avg(-F.col("y") * F.log(e) - (1 - F.col("y")) * F.log(1 - e)).alias("logloss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        F.sum(F.col("y") * hat).alias("tp"), F.sum((1 - F.col("y")) * hat).alias("fp"),
    )
    per = s.groupBy("s").agg(F.sum("y").alias("p1"), F.sum(1 - F.col("y")).alias("p0"))
    down = Window.orderBy(F.desc("s"))
    run = per.withColumn("tp_run", F.sum("p1").over(down)).withColumn("fp_run", F.sum("p0").over(down))
    area = run.agg(F.sum((F.col("tp_run") - F.col("p1") / 2) * F.col("p0")).alias("auc"), F.sum(F.col("p1") * F.col("tp_run") / (F.col("tp_run") + F.col("fp_run"))).alias("ap"))
    m = flat.crossJoin(F.broadcast(area))
    c = F.col
    recall, spec, precision = F.try_divide(c("tp"), c("pos")), F.try_divide(c("neg") - c("fp"), c("neg")), F.try_divide(c("tp"), c("tp") + c("fp"))
    return m.select(
        F.try_divide(c("auc"), c("pos") * c("neg")).alias("roc_auc"), F.try_divide(c("ap"), c("pos")).alias("pr_auc"), "logloss", "brier", ((c("tp") + c("neg") - c("fp")) / (c("pos") + c("neg"))).alias("accuracy"),
        ((recall + spec) / 2).alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("pos") - c("tp")).alias("f1"),
    )


def thresholds(scored: DataFrame) -> DataFrame:
    """t, tp, fp, fn, f1 for t = 0.05, 0.075, ... 0.95: one pass that counts rows per threshold that they reach, then sums from above."""
    grid = [round(0.05 + 0.025 * i, 3) for i in range(37)]
    k = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("p")))
    per = scored.groupBy(k.alias("k")).agg(F.sum("y").alias("y1"), F.sum(1 - F.col("y")).alias("y0"))
    every = per.sparkSession.createDataFrame([(i, t) for i, t in enumerate(grid)], "i int, t double")
    j = F.broadcast(every).crossJoin(per)  # 37 rows by 38 at most
    s = j.groupBy("i", "t").agg(F.sum(F.when(F.col("k") > F.col("i"), F.col("y1")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") > F.col("i"), F.col("y0")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("k") <= F.col("i"), F.col("y1")).otherwise(0)).alias("fn"))
    return s.select("t", "tp", "fp", "fn", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The threshold with the largest F1 (ties: the smallest)."""
    return thresholds(scored).agg(F.max(F.struct("f1", (-F.col("t")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("t"), "b.f1")


def multiclass_metrics(scored: DataFrame) -> DataFrame:
    """Per class (of rows label, predicted): support, precision, recall, f1; absent ones count 0."""
    pairs = scored.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    rows = pairs.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    j = rows.join(cols, "label", "left").withColumn("called", F.coalesce("called", F.lit(0)))
    p, r = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return j.select("label", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def multiclass_summary(scored: DataFrame) -> DataFrame:
    """One row over rows (label, probs: map of class to probability): n, accuracy, balanced_accuracy (mean recall of the classes that occur),
    macro_precision, macro_recall, macro_f1 (over classes that occur or are predicted; absent figures count 0), top3_accuracy, logloss.

    The class of the largest probability is predicted (ties: the first by name). Rows without a label or probability are left out.
    """
    ranked = F.transform(F.array_sort(F.transform(F.map_entries("probs"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), lambda e: e["k"])
    total = F.aggregate(F.map_values("probs"), F.lit(0.0), lambda a, x: a + x)
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.coalesce(F.try_divide(F.col("probs")[F.col("label")], total), F.lit(0.0))))
    rows = scored.where("label is not null and probs is not null and size(probs) > 0").select("label", F.get(ranked, F.lit(0)).alias("predicted"), F.array_contains(F.slice(ranked, 1, 3), F.col("label")).alias("near"), (-F.log(p)).alias("loss"))
    flat = rows.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg(F.col("near").cast("double")).alias("top3_accuracy"), F.avg("loss").alias("logloss"))
    pairs = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("own"), F.lit(0).cast("long").alias("called"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("own"), F.col("n").alias("called"), F.lit(0).cast("long").alias("tp")))).alias("e")).select("e.*")
    per = each.groupBy("c").agg(F.sum("own").alias("own"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    precision, recall = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "own"), F.lit(0.0))
    macro = per.agg(F.avg(F.when(F.col("own") > 0, recall)).alias("balanced_accuracy"), F.avg(precision).alias("macro_precision"), F.avg(recall).alias("macro_recall"), F.avg(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))).alias("macro_f1"))
    return flat.crossJoin(F.broadcast(macro))


def expanded(probs: Column, classes: list[str], eps: float = 1e-6) -> Column:
    """Probabilities (a map) over all classes: those that the model didn't know, and smaller ones, have eps; their sum is 1."""
    values = F.array(*(F.struct(F.lit(c).alias("key"), F.greatest(F.coalesce(probs[c], F.lit(eps)), F.lit(eps)).alias("value")) for c in classes))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x["value"])
    return F.map_from_entries(F.transform(values, lambda x: F.struct(x["key"].alias("key"), (x["value"] / total).alias("value"))))


def contiguous(rows: DataFrame, label: str) -> tuple[DataFrame, list]:
    """rows with y: the labels that occur as 0, 1, ...; and those labels in order. There are as many as classes."""
    names = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())
    number = F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, k))) if names else F.create_map()
    return rows.withColumn("y", number[F.col(label)].cast("int")) if names else rows.withColumn("y", F.lit(None).cast("int")), names


#: Most numeric columns, category columns and values of each that a model takes.
TOP_NUMERIC, TOP_COLUMNS, TOP_VALUES = 96, 4, 12


def feature_priority(weights: DataFrame, families: DataFrame) -> DataFrame:
    """column, priority: the feature's weight, else its family's share."""
    return weights.join(F.broadcast(families.select("family", "share")), "family", "left").select("column", F.coalesce("blended_weight", "share").alias("priority")).where("priority is not null")


def choose_features(occ: DataFrame, grid: DataFrame, frequencies: DataFrame, priority: dict[str, float], numeric: int = TOP_NUMERIC, columns: int = TOP_COLUMNS, values: int = TOP_VALUES) -> dict:
    """{"numeric": columns, "vocabulary": {column: values}}: what both tables have, by priority and then name; of each category column its most
    frequent values over all groups (frequencies: column, value, fraction_of_non_null; ties by value), in lower case."""
    from biotope.operators.ingest import categorical_features, numeric_features

    def best(find, most: int) -> list[str]:
        both = sorted(set(find(occ)) & set(find(grid)), key=lambda c: (-priority.get(c, 0.0), c))
        return both[:most] if most > 0 else both

    chosen = best(categorical_features, columns)
    ranked = Window.partitionBy("column").orderBy(F.desc("f"), "value")
    named = frequencies.where(F.col("column").isin(chosen)).select("column", normal_text(F.col("value")).alias("value"), F.col("fraction_of_non_null").alias("f")).where("value <> ''")
    top = named.groupBy("column", "value").agg(F.max("f").alias("f")).withColumn("rk", F.row_number().over(ranked)).where(F.col("rk") <= values)
    found: dict[str, list[str]] = {}
    for c, v in top.orderBy("column", "rk").select("column", "value").collect():  # columns * values at most
        found.setdefault(c, []).append(v)
    return {"numeric": best(numeric_features, numeric), "vocabulary": {c: found[c] for c in chosen if c in found}}


def feature_columns(rows: DataFrame, spec: dict) -> dict[str, Column]:
    """The model's columns: numbers as they are (missing ones, and columns that rows lack, null), and column__value for each chosen value: 1 or 0."""
    from biotope.functions.expr import number

    out = {c: number(F.col(c).cast("string")) if c in rows.columns else F.lit(None).cast("double") for c in spec["numeric"]}
    for c, vocabulary in spec["vocabulary"].items():
        own = F.coalesce(normal_text(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit("")
        for v in vocabulary:
            out[f"{c}__{'_'.join(x for x in re.split('[^A-Za-z0-9._-]+', v) if x).strip('._')}"] = (own == v).cast("int")
    return out


def calibration_fold(rows: DataFrame, fraction: float = 0.2) -> DataFrame:
    """fold, n, share: the fold to calibrate on, whose share of the rows (fold, y) is nearest to the fraction (ties: the smallest fold), among
    those that have both classes and leave both to the others. None: no row."""
    f = max(0.05, min(0.5, fraction))
    per = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"))
    every = Window.partitionBy()  # a row a fold
    j = per.withColumn("all_n", F.sum("n").over(every)).withColumn("all_pos", F.sum("pos").over(every))
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n")) & (F.col("all_pos") > F.col("pos")) & (F.col("all_n") - F.col("all_pos") > F.col("n") - F.col("pos"))
    share = F.col("n") / F.col("all_n")
    return j.where(both).select("fold", "n", share.alias("share")).orderBy(F.abs(share - f), "fold").limit(1)


def training_threshold(rows: DataFrame, fit, fraction: float = 0.2) -> float:
    """The threshold of best F1 on the calibration fold, for fit(training rows) -> a function that adds p; 0.5 without such a fold."""
    chosen = calibration_fold(rows, fraction).first()
    if chosen is None:
        return 0.5
    return best_threshold(fit(rows.where(F.col("fold") != chosen.fold))(rows.where(F.col("fold") == chosen.fold))).first().t


def compare(candidates: dict, rows: DataFrame) -> list[dict]:
    """The candidates, the best first: name, means over folds of the metrics on held-out rows (cv_<metric>), the same over all held-out rows together
    (oof_<metric>), folds. candidates: name -> fit(training rows) -> a function that adds p. Order: cv_pr_auc and oof_pr_auc (largest),
    cv_logloss and cv_brier (smallest), cv_balanced_accuracy (largest), name. Folds with one class on either side are left out."""
    out, names = [], sorted(r[0] for r in rows.select("fold").distinct().collect())
    classes = {r.fold: (r.a, r.b) for r in rows.groupBy("fold").agg(F.min("y").alias("a"), F.max("y").alias("b")).collect()}  # of k folds
    for name, fit in candidates.items():
        held, per = None, []
        for f in names:
            others = [c for k, c in classes.items() if k != f]
            if classes[f][0] == classes[f][1] or not others or min(a for a, _ in others) == max(b for _, b in others):
                continue
            part = fit(rows.where(F.col("fold") != f))(rows.where(F.col("fold") == f)).select("fold", "y", "p")
            per.append(binary_metrics(part).first().asDict())
            held = part if held is None else held.unionByName(part)
        if per:
            oof = binary_metrics(held).first().asDict()
            out.append({"model": name, **{f"cv_{m}": sum(x[m] or 0.0 for x in per) / len(per) for m in oof}, **{f"oof_{m}": v for m, v in oof.items()}, "folds": len(per)})
    return sorted(out, key=lambda r: (-r["cv_pr_auc"], -r["oof_pr_auc"], r["cv_logloss"], r["cv_brier"], -r["cv_balanced_accuracy"], r["model"]))


def variances(df: DataFrame, columns: list[str], least: float = 1e-10) -> DataFrame:
    item = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    return df.select(item.alias("i")).groupBy("i.column").agg(F.var_pop("i.v").alias("variance")).withColumn("kept", F.col("variance") > least)


def correlations(df: DataFrame, columns: list[str], most: float = 0.98) -> DataFrame:
    """Per column pair (one before two in order): r, and whether `two` is dropped for it. One pass over the rows."""
    both = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(both)))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(both)))).alias("p")).select("p.*")
    return out.withColumn("dropped", F.coalesce(F.abs("r") > most, F.lit(False)))


def community(shares: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per cell (id) over rows (grp, share): the best and second group, their gap, groups at the threshold, effective richness 1 / sum of squares."""
    a = shares.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "grp"))), 1, 2).alias("top"), F.count_if(F.col("share") >= threshold).alias("n_above"), F.sum(F.pow("share", F.lit(2.0))).alias("sq"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    return a.select("id", first["grp"].alias("top_group"), (-first["s"]).alias("top_share"), second["grp"].alias("second_group"), (second["s"] - first["s"]).alias("gap"), "n_above", F.try_divide(F.lit(1.0), "sq").alias("effective_richness"))


def community_groups(shares: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per group over rows (id, grp, share): mean and largest share, cells where it is the first (ties: by name), cells at the threshold. A
    cell without the group counts 0 in the mean."""
    first = shares.groupBy("id").agg(F.min(F.struct((-F.col("share")).alias("s"), "grp"))["grp"].alias("grp"))
    cells = shares.agg(F.countDistinct("id").alias("cells"))
    wins = first.groupBy("grp").agg(F.count("*").alias("top_wins"))
    own = shares.groupBy("grp").agg(F.sum("share").alias("s"), F.max("share").alias("max_share"), F.count_if(F.col("share") >= threshold).alias("n_above"))
    j = own.join(wins, "grp", "left").crossJoin(F.broadcast(cells))
    return j.select("grp", (F.col("s") / F.col("cells")).alias("mean_share"), "max_share", F.coalesce("top_wins", F.lit(0)).alias("top_wins"), "n_above")


def folds(df: DataFrame, size: float, k: int = 5) -> DataFrame:
    """df with a fold from its spatial block: blocks go, largest first, round the folds and back (serpentine), which evens their sizes."""
    from biotope.operators.space import block

    blocks = df.groupBy(*block(size)).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "bx", "by")) - 1  # a row a block
    lap, at = F.floor(place / k), place % k
    numbered = blocks.withColumn("fold", F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int")).drop("n")
    return df.select("*", *block(size)).join(numbered, ["bx", "by"]).drop("bx", "by")


def conservative(cells: DataFrame, presence: DataFrame, columns: list[str], raw: str = "p", weights: dict[str, float] | None = None, top: int = 24) -> DataFrame:
    """Scores lowered away from the middle and the edge of what the presences cover: id, raw, center, novelty, adjusted. weights: importance by
    column, of which the `top` largest count (ties by name; none: equal ones); scores are kept within 0..1, missing ones stay missing."""
    weights = {c: max(0.0, (weights or {}).get(c, 0.0 if weights else 1.0)) for c in columns}
    columns = sorted(columns, key=lambda c: (-weights[c], c))[:top]
    weights = {c: max(weights[c], 1e-8) for c in columns}
    stats = presence.agg(*(x for c in columns for x in (F.percentile(c, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias(f"q_{c}"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s_{c}"))))
    j = cells.crossJoin(F.broadcast(stats))
    center, out, w = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c in columns:
        q10, q25, q50, q75, q90 = (F.get(f"q_{c}", F.lit(i)) for i in range(5))
        spread = F.greatest(q90 - q10, q75 - q25, F.col(f"s_{c}"), F.lit(1e-6))
        scale = F.greatest(1.5 * (q75 - q25), 0.35 * spread, F.lit(1e-6))
        d = F.abs(F.col(c) - q50) / scale
        beyond = F.least(F.greatest(q10 - 0.15 * spread - F.col(c), F.col(c) - q90 - 0.15 * spread, F.lit(0.0)) / spread, F.lit(6.0))
        known = F.col(c).isNotNull()
        center, out, w = center + F.when(known, weights[c] / (1 + F.pow(d, F.lit(1.6)))).otherwise(0.0), out + F.when(known, weights[c] * beyond).otherwise(0.0), w + F.when(known, weights[c]).otherwise(0.0)
    j = j.select("id", F.col(raw).isNotNull().alias("known"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col(raw).isNotNull(), F.col(raw)))).alias("raw"), F.try_divide(center, F.nullif(w, F.lit(0.0))).alias("center"), F.exp(-1.75 * F.try_divide(out, F.nullif(w, F.lit(0.0)))).alias("novelty"))
    adj = (0.4 + 0.6 * F.pow("center", F.lit(1.25))) * (0.08 + 0.92 * F.col("novelty"))
    return j.withColumn("raw", F.when(F.col("known"), F.col("raw"))).withColumn("adjusted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow("raw", F.lit(1.1)) * adj))).withColumn("adjusted", F.when(F.col("known") & F.col("center").isNotNull(), F.col("adjusted"))).drop("known")


def fit_presence(rows: DataFrame, features: list[str], trees: int = 20, seed: int = 42):
    """A forest on rows (y, features), with missing values at the training median and classes of equal weight."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    w = class_weights(rows, "y").select(F.col("label").alias("y"), F.col("weight").alias("w"))
    filled = [f"{c}_filled" for c in features]
    steps = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_assembled"), RandomForestClassifier(featuresCol="_assembled", labelCol="y", weightCol="w", numTrees=trees, maxDepth=6, seed=seed)]
    return Pipeline(stages=steps).fit(rows.join(F.broadcast(w), "y"))


def predict(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))


def buffered_train(rows: DataFrame, fold: int, size: float, buffer: int) -> DataFrame:
    """The rows of other folds that lie in no block within `buffer` blocks of the fold's."""
    from biotope.operators.space import outside_buffer

    return outside_buffer(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), size, buffer)


def background(candidates: DataFrame, target: int, mode: str, local: Column, share: float = 0.7, key: str = "id") -> DataFrame:
    """`target` rows in hash order. regional: from the local ones if they are at least half of it, else from all; global: from all; mixed: the
    share from the local ones, then from the others, then whatever is left."""
    ranked = candidates.withColumn("_local", F.coalesce(local, F.lit(False)))
    if mode == "regional":
        many = ranked.where("_local").limit(-(-target // 2)).count() >= target / 2
        ranked = ranked.where("_local") if many else ranked
        return ranked.orderBy(hash_order(key), key).limit(target).drop("_local")
    if mode == "global":
        return ranked.orderBy(hash_order(key), key).limit(target).drop("_local")
    near, far = (ranked.where(c).orderBy(hash_order(key), key).limit(n).withColumn("_rk", F.lit(k)) for k, (c, n) in enumerate((("_local", round(target * share)), ("not _local", target))))
    rest = ranked.join(near.select(key).union(far.select(key)), key, "left_anti").orderBy(hash_order(key), key).limit(target).withColumn("_rk", F.lit(2))
    return near.unionByName(far).unionByName(rest).orderBy("_rk", hash_order(key), key).limit(target).drop("_local", "_rk")


def out_of_fold(rows: DataFrame, features: list[str], trees: int = 20) -> DataFrame:
    """rows with p from a forest fitted on the other folds; folds whose training rows have one class are left out."""
    out = None
    for (f,) in sorted(rows.select("fold").distinct().collect()):  # of k folds
        train = rows.where(F.col("fold") != f)
        if train.select("y").distinct().count() > 1:
            part = predict(fit_presence(train, features, trees), rows.where(F.col("fold") == f)).select(*rows.columns, "p")
            out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(model, rows: DataFrame, features: list[str], repeats: int = 5, key: str = "id") -> list[tuple[str, float]]:
    """Each feature's mean loss of average precision when its values are dealt anew: by hash, from the row at the same rank."""
    base = binary_metrics(predict(model, rows)).first().pr_auc
    out = []
    for c in features:
        lost = 0.0
        for seed in range(repeats):
            own = rows.withColumn("_i", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key)))
            own = own.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(64)))
            other = own.select("_b", F.row_number().over(Window.partitionBy("_b").orderBy(hash_order(key, seed=seed))).alias("_i"), F.col(c).alias("_v"))
            dealt = own.join(other, ["_b", "_i"]).withColumn(c, F.col("_v")).drop("_b", "_i", "_v")
            lost += (base - binary_metrics(predict(model, dealt)).first().pr_auc) / repeats
        out.append((c, lost))
    return sorted(out, key=lambda x: -x[1])


def fit_community(rows: DataFrame, features: list[str], label: str = "grp", trees: int = 20, seed: int = 42):
    """A forest over many classes with classes of equal weight: a function that adds probs (a map over the classes that it was fitted on)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    numbered, names = contiguous(rows, label)
    w = class_weights(numbered, "y").select(F.col("label").alias("y"), F.col("weight").alias("w"))
    filled = [f"{c}_filled" for c in features]
    steps = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_assembled"), RandomForestClassifier(featuresCol="_assembled", labelCol="y", weightCol="w", numTrees=trees, maxDepth=6, seed=seed)]
    model = Pipeline(stages=steps).fit(numbered.join(F.broadcast(w), "y"))

    def add(new: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        probs = F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("key"), F.get(p, F.lit(k)).alias("value")) for k, n in enumerate(names))))
        return model.transform(new).select(*new.columns, probs.alias("probs"))

    return add


def community_out_of_fold(rows: DataFrame, features: list[str], label: str = "grp", trees: int = 20) -> DataFrame:
    """rows with probs over all classes from a forest fitted on the other folds; classes that those lack have the least probability."""
    _, names = contiguous(rows, label)
    out = None
    for (f,) in sorted(rows.select("fold").distinct().collect()):  # of k folds
        train = rows.where(F.col("fold") != f)
        if train.select(label).distinct().count() > 1:
            part = fit_community(train, features, label, trees)(rows.where(F.col("fold") == f)).withColumn("probs", expanded(F.col("probs"), names))
            out = part if out is None else out.unionByName(part)
    return out


def redeploy(path: str, rows: DataFrame) -> DataFrame:
    """rows with p from a model of fit_presence() that was saved (model.write().save(path))."""
    from pyspark.ml import PipelineModel

    return predict(PipelineModel.load(path), rows)
