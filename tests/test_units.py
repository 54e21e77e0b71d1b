"""Formulas against rows computed by hand, files, and rules that hold whatever the data."""

import pytest
from pyspark.sql import functions as F

from biotope.functions import expr as X
from biotope.operators import cooccur, ingest, raster, space, suitability, taxonomy
from biotope.sources import delimited
from biotope.streaming import append


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_trapezoid(spark):
    for x, want in zip((-1, 0, 1, 2, 3, 4, 6, 8, 9), (0, 0, 0.5, 1, 1, 1, 0.5, 0, 0)):
        assert one(spark, v=X.trapezoid(*lit(x, 0, 2, 4, 8))).v == want
    assert one(spark, v=X.trapezoid(*lit(5, 5, 5, 5, 5))).v == 1


def test_overlap_and_proximity(spark):
    r = one(spark, a=X.interval_overlap(*lit(0, 4, 2, 6)), b=X.proximity(*lit(3, 5, 10)), c=X.interval_overlap(*lit(1, 1, 1, 1)))
    assert (r.a, r.b, r.c) == (pytest.approx(2 / 6), pytest.approx(0.8), 1)


def test_association(spark):
    r = one(spark, **X.association(*lit(2, 4, 5, 20)))
    assert (r.p_b_given_a, r.lift, r.jaccard, r.overlap, r.cond) == (0.5, 2, pytest.approx(2 / 7), 0.5, 0.5)
    assert one(spark, **X.association(*lit(4, 4, 4, 4))).npmi == 0


def test_lower_tail(spark):
    r = one(spark, v=suitability.lower_tail(F.array(*lit(0.2, 0.4, 0.6), F.lit(None).cast("double")), F.lit(4), 0.5, 1.0))
    assert r.v == pytest.approx((0.2 + 0.4 * 0.5) / 1.5)


def test_gate_and_cleaning(spark):
    r = one(spark, g=X.gate(*lit(0.8, 0.25)), n=X.number(F.lit("nan")), m=X.number(F.lit("x")), v=X.valid_lat_lon(F.lit("91"), F.lit("0")), w=X.valid_lat_lon(F.lit("-90"), F.lit("180")), b=X.blank(F.lit(" NULL ")), u=X.within_uncertainty(F.lit(None).cast("double"), 10, 1))
    assert r.g == pytest.approx(0.8 * (0.35 + 0.65 * 0.5)) and (r.n, r.m, r.v, r.w, r.b, r.u) == (None, None, False, True, True, True)


def test_neighbours_in_order():
    assert raster.neighbours(1) == [(-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)]
    assert len(raster.neighbours(3)) == 48 and len(raster.neighbours(2, True)) == 12


def test_row_ids_are_dense_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = ingest.with_row_ids(rows, ["k"], start=3).orderBy("k").collect()
    assert [r.row_id for r in got] == list(range(3, 1003))
    assert ingest.with_row_ids(rows.limit(0), ["k"]).count() == 0


def test_prepared_grid_keeps_all_finite_coordinates(spark):
    """Beyond 90 and 180 too: coordinates may be those of a projection. Only missing and infinite ones go."""
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, " ", 500.5, 10.0), (2, "a", 1.0, 133.75), (3, "b", nan, 0.0), (4, "c", 0.0, -inf), (5, "d", None, 0.0), (6, None, -1e7, -91.0), (7, " e ", 180.0, 90.0)], "n long, id string, lon double, lat double")
    got = sorted((r.id, r.lon, r.lat) for r in ingest.prepared_grid(rows, ["n"]).collect())
    assert got == [("a", 1.0, 133.75), ("e", 180.0, 90.0), ("g1", 500.5, 10.0), ("g3", -1e7, -91.0)]


def test_rollup_sums_to_parent(spark):
    occ = spark.createDataFrame([("a", "b", "c", "d", "e", "f", s) for s in ("x", "x", " y", None, "")], taxonomy.RANKS)
    tree = {r.path: r for r in taxonomy.nodes(occ).collect()}
    assert tree[""].obs_count == 5 and tree["a/b/c/d/e/f"].obs_count == 5 and tree["a/b/c/d/e/f/(missing)"].obs_count == 2 and tree["a/b/c/d/e/f/y"].obs_count == 1


def test_selectors():
    assert taxonomy.parse_selector("Order = Rosales") == ("ord", "Rosales") and taxonomy.parse_selector(" Rosa ") == (None, "Rosa")
    with pytest.raises(ValueError):
        taxonomy.parse_selector("tribe:x")


def test_pairs_do_not_depend_on_partitions(spark):
    occ = spark.createDataFrame([(f"s{i % 5}", float(i % 7), float(i % 3), None) for i in range(200)], "species string, lon double, lat double, unc double")
    seen = set()
    for n in (1, 8):
        p = cooccur.associates(cooccur.usable(cooccur.presence(occ.repartition(n), [(200_000.0, 0.0, 0.0)])))
        rows = p.select("a", "b", "shared", "jaccard").collect()
        assert all(0 <= r.jaccard <= 1 for r in rows) and {(r.a, r.b, r.shared) for r in rows} == {(r.b, r.a, r.shared) for r in rows}
        seen.add(tuple(sorted(map(tuple, rows))))
    assert len(seen) == 1


def test_polygon_and_lattice(spark):
    assert space.inside(space.lattice(spark, 0, 0, 4, 4, 1), [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]).count() == 4


def test_delimited_files(spark, tmp_path):
    assert [delimited.delimiter(h) for h in ("a,b", 'a;"b,c,d";e', "a\tb|c", "abc")] == [",", ";", "\t", ","]
    assert delimited.split_header('a,"b ""x"", y",c"d', ",") == ["a", 'b "x", y', 'c"d']
    f = tmp_path / "p.csv"
    f.write_text('Name;Longitude;Latitude;note\r\n1;10.5;20;"two\nlines; here"\r\n2;x;5;\r\n')
    assert [tuple(r) for r in delimited.read_points(spark, str(f)).collect()] == [("1", 10.5, 20.0), ("2", None, 5.0)]
    assert delimited.read_points(spark, str(f), keep_bad=False).count() == 1
    assert delimited.read(spark, str(f), ["NOTE", "missing"]).collect()[0][0] == "two\nlines; here"
    delimited.write_by_species(spark.createDataFrame([("a/b", 1), ("CON", 2)], "species string, n int"), str(tmp_path / "out"), ["species"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["species_folder=_CON", "species_folder=a_b"]


def test_append(spark, tmp_path):
    path, src = str(tmp_path / "t"), tmp_path / "in"
    spark.createDataFrame([(1, "a")], "id long, k string").write.parquet(path)
    append.append_to(path, spark.createDataFrame([(2, "b")], "id long, k string"))
    with pytest.raises(ValueError):
        append.append_to(path, spark.createDataFrame([(2,)], "id long"))
    assert spark.read.parquet(path).count() == 2
    src.mkdir()
    for k in range(2):  # a second call reads only the new file
        (src / f"{k}.csv").write_text(f"id,k\n{k},x\n")
        append.follow(spark, str(src), "id long, k string", str(tmp_path / "s"), str(tmp_path / "c"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [0, 1]


def test_year_fold(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 2.0), (None, None)], "terraclimate_ppt_2019_mean double, terraclimate_ppt_2020_mean double")
    assert [r[0] for r in ingest.fold_years(df).collect()] == [2.0, 2.0, None]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())


def test_stress_by_hand(spark):
    """lo 0, q25 2, q75 4, hi 10: the grace ends at 5.5 on the high side, at 0.5 on the low one."""
    high = [one(spark, v=suitability.stress(*lit(x, 0, 2, 4, 10), "high")).v for x in (5, 5.5, 8, 9.1, 20)]
    assert high == [pytest.approx(v) for v in (1, 1, 0.6875, 0.55, 0.55)]
    low = [one(spark, v=suitability.stress(*lit(x, 0, 2, 4, 10), "low")).v for x in (3, 0.5, 0.3, 0.05, -4)]
    assert low == [pytest.approx(v) for v in (1, 1, 1 - 0.45 * 0.25, 0.55, 0.55)]  # room 0.5, but a tenth of the span counts
    assert one(spark, v=suitability.stress(*lit(8, 0, 2, 4, 10), "high", 2.0)).v == pytest.approx(1 - 0.45 * (1 - (1 - 0.694444444) ** 2))
    assert one(spark, v=suitability.stress(*lit(8, 0, 2, 4, 10), None)).v is None
    assert suitability.stress_rule("terraclimate_tmean_mean") == ("heat", "high") and suitability.stress_rule("terraclimate_pdsi") == ("moisture_balance", "low")
    assert [suitability.stress_side(n) for n in ("terraclimate_def", "terraclimate_tmin", "dem_slope", "terraclimate_pptx", "terraclimate_soil")] == [None] * 5


def test_weights_without_one_of_their_own(spark):
    profile = spark.createDataFrame([("g", c, 3, 0.0, 1.0, 2.0, 3.0) for c in ("dem_a", "twi_b", "glim_c", "odd", "terraclimate_vpd")] + [("h", "dem_a", 0, 0.0, 1.0, 2.0, 3.0)], "grp string, column string, n_valid int, min double, q25 double, q75 double, max double")
    weights = spark.createDataFrame([("dem_a", 0.5), ("twi_b", 0.0), ("glim_c", None)], "column string, blended_weight double")
    got = {r.column: r for r in suitability.models(profile, weights, families=spark.createDataFrame([("twi", 0.25)], "family string, share double")).collect()}
    total = 0.5 + 0.25 + 0.8 + 0.8 + 1.0  # its own, its family's share, the families' priors
    assert {c: r.w for c, r in got.items()} == {c: pytest.approx(w / total) for c, w in (("dem_a", 0.5), ("twi_b", 0.25), ("glim_c", 0.8), ("odd", 0.8), ("terraclimate_vpd", 1.0))}
    assert [c for c, r in got.items() if r.stressed] == ["terraclimate_vpd"]
    assert not [r for r in suitability.models(profile, weights, least_stress=2).collect() if r.stressed] and suitability.models(profile, weights, least_features=6).count() == 0


def test_weights_read_the_values_once(spark):
    from biotope.operators import profile

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    values = spark.range(90).select(F.concat(F.lit("g"), F.col("id") % 3).alias("grp"), F.lit("dem_a").alias("column"), F.lit("dem").alias("family"), F.udf(counted, "double")((F.col("id") * 7 % 31).cast("double")).alias("value"))
    assert profile.feature_weights(values).first().blended_weight == 1
    assert seen.value == 90


def test_scores_of_many_cells(spark):
    """One file of cells is scored by all tasks, by methods that the JVM compiles (8,000 bytes at most)."""
    import re

    features = ["dem_a", "soilgrids_b", "twi_c", "terraclimate_ppt_mean"]
    cells = spark.range(1000).select("id", *((F.col("id") * (k + 3) % 11).cast("double").alias(c) for k, c in enumerate(features)), F.lit("A").alias("cat")).coalesce(1)
    envelopes = spark.createDataFrame([(g, c, 0.0, 2.0, 5.0, 10.0, 0.25, c[:4] == "terr") for g in "xy" for c in features], "grp string, column string, min double, q25 double, q75 double, max double, w double, stressed boolean")
    shares = spark.createDataFrame([("x", "A", 1.0)], "grp string, value string, f double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scores = suitability.score(cells, envelopes, shares, "cat")
        assert scores.rdd.getNumPartitions() >= 4
        code = spark.sparkContext._jvm.PythonSQLUtils.explainString(scores._jdf.queryExecution(), "codegen")
        assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert scores.count() == 2000 and scores.where("adjusted is null").count() == 0


def test_histogram_leaves_missing_scores_out(spark):
    scores = spark.createDataFrame([("a", 0.1), ("a", None), ("a", 1.0), ("b", None), ("c", 0.0)], "grp string, adjusted double")
    got = sorted(tuple(r) for r in suitability.histogram(scores, bins=4).collect())
    assert got == [("a", 0, 1, 0.5), ("a", 3, 1, 1.0), ("c", 0, 1, 1.0)]


def test_models_in_blocks(spark, monkeypatch):
    """More groups than are broadcast at once give the same scores."""
    from conftest import SF

    from biotope.plans import queries

    a = sorted(queries.suitability_scores(spark, SF).collect())
    monkeypatch.setattr(suitability, "MODELS", 20)
    assert sorted(queries.suitability_scores(spark, SF).collect()) == a


def test_samples_of_layers(spark):
    cells = spark.createDataFrame([("a", 1, 0, 0, 1.0), ("b", 1, 0, 0, 2.0), ("a", 2, 0, 0, None), ("a", 2, 0, 1, 4.0)], "layer string, band int, r long, c long, value double")
    points = spark.createDataFrame([(1, "a", 1, 0, 0), (1, "b", 1, 0, 0), (1, "a", 2, 0, 0), (2, "c", 1, 0, 0)], "id long, layer string, band int, r long, c long")
    got = {(r.id, r.layer, r.band): (r.value, r.found) for r in raster.sample(points, cells, 1).collect()}
    assert got == {(1, "a", 1): (1.0, 0), (1, "b", 1): (2.0, 0), (1, "a", 2): (4.0, 3), (2, "c", 1): (None, None)}


def test_choice_of_models(spark):
    from biotope.operators import ml

    rows = spark.createDataFrame([(f, i, i % 2, float(i % 2) + 0.01 * i) for f in range(3) for i in range(10)] + [(3, 0, 1, 1.0)], "fold int, id long, y long, x double")
    good, flat = (lambda train, c=c: lambda new: new.withColumn("p", c) for c in (F.least(F.lit(1.0), F.col("x") / 1.2), F.lit(0.5)))
    table = ml.compare({"flat": flat, "good": good, "also": good}, rows)
    assert [r["model"] for r in table] == ["also", "good", "flat"] and table[0]["cv_pr_auc"] == 1 and {r["folds"] for r in table} == {3}
    assert ml.calibration_fold(rows, 0.3).first().fold == 0 and ml.calibration_fold(rows.where("y = 1")).count() == 0
    assert ml.training_threshold(rows, good, 0.3) == 0.075 and ml.training_threshold(rows.where("y = 1"), good) == 0.5


def test_community_model(spark, tmp_path):
    from biotope.operators import ml

    rows = spark.createDataFrame([(i, i % 3, "abc"[i % 3] if i < 90 else "d", float(i % 3) + 0.01 * (i % 7), (i // 3) % 3) for i in range(91)], "id long, k int, grp string, x double, fold int")
    held = ml.community_out_of_fold(rows, ["x"], trees=5)
    got = held.collect()
    assert len(got) == 91 and all(sum(r.probs.values()) == pytest.approx(1) and set(r.probs) == set("abcd") and min(r.probs.values()) > 0 for r in got)
    assert ml.multiclass_summary(held.select(F.col("grp").alias("label"), "probs")).first().accuracy > 0.9
    binary = rows.select("id", (F.col("k") == 0).cast("long").alias("y"), "x")
    model = ml.fit_presence(binary, ["x"], trees=3)
    model.write().save(str(tmp_path / "m"))
    assert ml.redeploy(str(tmp_path / "m"), binary).select("id", "p").orderBy("id").collect() == ml.predict(model, binary).select("id", "p").orderBy("id").collect()
    assert ml.contiguous(binary.limit(0).withColumn("l", F.lit("a")), "l")[1] == []
    spec = {"numeric": ["x", "none"], "vocabulary": {"grp": ["a", "b/c d"]}}
    assert list(ml.feature_columns(rows, spec)) == ["x", "none", "grp__a", "grp__b_c_d"]


def test_summary_rows_of_features(spark):
    rows = spark.createDataFrame([(c,) for c in ("dem_elev", "dem_x", "lon", "glim", "glim_a", "dem_continent", None, "twi_is_nodata", "soilgrids_clay")], "column string")
    assert [r[0] for r in ingest.of_features(rows).collect()] == ["dem_elev", "soilgrids_clay"]
