from pyspark.sql import functions as F

from biotope.operators import ml
from biotope.sources import layers


def test_names_and_years():
    assert layers.dataset_name("clay_0-5cm_mean") == ("clay", "0-5cm", "mean") and layers.dataset_name("clay") is None
    assert layers.dataset_names(["clay", "clay"], ["0-5cm"]) == ["clay_0-5cm_mean"]
    assert layers.years("latest, 2017-2015,2016", 2024) == [2024, 2017, 2016, 2015]


def test_mosaic(spark, tmp_path):
    rect = lambda n, x, y, w, h: f'<{n} xOff="{x}" yOff="{y}" xSize="{w}" ySize="{h}"/>'
    src = lambda f, *r: f'<SimpleSource><SourceFilename relativeToVRT="1">{f}</SourceFilename>{rect("SrcRect", *r[:4])}{rect("DstRect", *r[4:])}</SimpleSource>'
    (tmp_path / "m.vrt").write_text(f'<VRTDataset><VRTRasterBand band="1">{src("a.tif", 0, 0, 10, 10, 0, 0, 20, 20)}{src("b.tif", 5, 5, 10, 10, 10, 10, 10, 10)}</VRTRasterBand></VRTDataset>')
    found = layers.mosaic_sources(spark, str(tmp_path / "m.vrt"))
    assert [(r.place, r.file, r.s_w, r.d_w) for r in found.orderBy("place").collect()] == [(0, "a.tif", 10, 20), (1, "b.tif", 10, 10)]
    points = spark.createDataFrame([(1, 3, 5), (2, 15, 15), (3, 30, 1)], "id long, r long, c long")
    assert [tuple(r) for r in layers.source_pixel(points, found, 8).orderBy("id").collect()] == [(1, 3, 5, "a.tif", 1, 2), (2, 15, 15, "a.tif", 7, 7), (3, 30, 1, None, None, None)]


def test_tiles_and_lookup(spark, tmp_path):
    for n in ("dem_x-5_y10.tif", "dem_x-5_y10_cog.tif", "dem_x0_y10.tif", "other.tif"):
        (tmp_path / n).write_bytes(b"x")
    got = {(r.x, r.y): r.path.rsplit("/", 1)[1] for r in layers.tiles(spark, str(tmp_path)).collect()}
    assert got == {(-5, 10): "dem_x-5_y10_cog.tif", (0, 10): "dem_x0_y10.tif"}
    (tmp_path / "l.csv").write_text("code,name\n1,a\nx,b\n2.0,c\n")
    assert [tuple(r) for r in layers.lookup(spark, str(tmp_path / "l.csv"), "code").orderBy("code").collect()] == [(1, "a"), (2, "c")]


def test_boundary(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}},{"geometry":{"type":"MultiPolygon","coordinates":[[[[10,0],[12,0],[12,2],[10,2],[10,0]]]]}}]}')
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 11.0, 1.0), (4, 6.0, 1.0)], "id long, x double, y double")
    assert sorted(r.id for r in layers.inside_rings(points, layers.rings(spark, str(tmp_path / "b.json"))).collect()) == [1, 3]


def test_samples_and_folds(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20 * 1.0).alias("lon"), (F.floor(F.col("id") / 20) * 1.0).alias("lat"), (F.col("id") % 20 > 9).cast("double").alias("y"), F.rand(1).alias("noise"))
    rows = rows.withColumn("signal", F.col("y") + F.col("noise") / 2)
    f = ml.folds(rows, 5.0, 4)
    assert f.count() == 400 and f.select("fold").distinct().count() == 4
    train = ml.buffered_train(f, 0, 5.0, 0)
    assert train.where("fold = 0").count() == 0 and ml.buffered_train(f, 0, 5.0, 1).count() < train.count()
    local = F.col("lon") < 5
    assert ml.background(rows, 50, "mixed", local).where(local).count() == 35 and ml.background(rows, 50, "regional", local).where(~local).count() == 0
    assert ml.background(rows, 1000, "mixed", local).count() == 400 and ml.background(rows, 30, "global", local).count() == 30
    scored = ml.out_of_fold(f, ["signal", "noise"], trees=5)
    assert scored.count() == 400 and ml.binary_metrics(scored).first().roc_auc > 0.95
    model = ml.fit_presence(rows, ["signal", "noise"], trees=5)
    assert ml.permutation_importance(model, rows, ["signal", "noise"], repeats=1)[0][0] == "signal"
