"""Queries over the driver's tables, one or more for each operator, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.functions import expr as X
from biotope.functions.expr import r6
from biotope.operators import cooccur, ingest, ml, profile, raster, space, suitability, surface, taxonomy
from biotope.plans import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; sql follows the stand-in tables' definitions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = V.sql(sql)
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


SCALE = 400_000.0
_ASSOC = """
pres AS (SELECT DISTINCT scale, px, py, CAST(floor((6378137.0 * radians(lon) - px * scale) / scale) AS BIGINT) + dx AS cx,
    CAST(floor((6378137.0 * ln(tan(0.7853981633974483 + radians(greatest(-85.05112878, least(85.05112878, lat))) / 2)) - py * scale) / scale) AS BIGINT) + dy AS cy, species AS sid
  FROM occ CROSS JOIN variants CROSS JOIN offsets),
ok AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY scale, px, py, cx, cy) AS rich FROM pres) WHERE rich <= 150),
cells AS (SELECT scale, px, py, sid, count(*) AS n FROM ok GROUP BY ALL),
tot AS (SELECT scale, px, py, count(DISTINCT (cx, cy)) AS t FROM ok GROUP BY ALL),
pr AS (SELECT p.scale, p.px, p.py, p.sid AS a, q.sid AS b, count(*) AS shared FROM ok p JOIN ok q USING (scale, px, py, cx, cy) WHERE p.sid < q.sid GROUP BY ALL HAVING count(*) >= 2),
sym AS (SELECT * FROM pr UNION ALL SELECT scale, px, py, b, a, shared FROM pr),
m AS (SELECT s.*, CAST(x.n AS DOUBLE) AS a_cells, CAST(y.n AS DOUBLE) AS b_cells, CAST(t AS DOUBLE) AS t, CAST(shared AS DOUBLE) AS s FROM sym s
  JOIN cells x ON x.scale = s.scale AND x.px = s.px AND x.py = s.py AND x.sid = s.a JOIN cells y ON y.scale = s.scale AND y.px = s.px AND y.py = s.py AND y.sid = s.b
  JOIN tot ON tot.scale = s.scale AND tot.px = s.px AND tot.py = s.py),
m2 AS (SELECT *, (s * t) / (a_cells * b_cells) AS lift, (s + 1) / (a_cells + 2) AS cond FROM m),
m3 AS (SELECT *, CASE WHEN s = t THEN 0 ELSE ln(lift) / -ln(s / t) END AS npmi FROM m2),
m4 AS (SELECT *, s / (s + 5) * (0.55 * greatest(0, npmi) + 0.30 * cond + 0.15 * CASE WHEN lift > 1 THEN ln(lift) / (1 + ln(lift)) ELSE 0 END) AS score FROM m3 WHERE a_cells >= 2 AND npmi >= 0 AND lift >= 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scale, px, py, a ORDER BY score DESC, shared DESC, lift DESC, b) AS rank FROM m4)
"""


@query(f"""variants AS (SELECT {SCALE} AS scale, 0.0 AS px, 0.0 AS py), offsets AS (SELECT 0 AS dx, 0 AS dy), {_ASSOC}
SELECT a, b, shared, CAST(rank AS INTEGER) AS rank, round(lift, 6) AS lift, round(npmi, 6) AS npmi, round(score, 6) AS score, round(s / (a_cells + b_cells - s), 6) AS jaccard FROM ranked WHERE rank <= 3""")
def cooccur_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccur.usable(cooccur.presence(V.occ(spark, sf_dir), [(SCALE, 0.0, 0.0)]))
    return cooccur.associates(found, k=3).select("a", "b", "shared", "rank", r6("lift").alias("lift"), r6("npmi").alias("npmi"), r6("score").alias("score"), r6("jaccard").alias("jaccard"))


@query(f"""variants AS (SELECT * FROM (VALUES ({SCALE}, 0.0, 0.0), ({SCALE}, 0.5, 0.5), (900000.0, 0.0, 0.0)) v(scale, px, py)), offsets AS (SELECT 0 AS dx, 0 AS dy), {_ASSOC},
r AS (SELECT a, b, scale, px, py, shared, round(score, 8) AS score, round(lift, 8) AS lift FROM ranked WHERE rank <= 5),
c AS (SELECT a, b, count(*) AS n_variants, list_sort(list_distinct(list(CAST(scale AS BIGINT)))) AS ss, avg(score) AS mean_score,
  list_sort(list_distinct(list(CAST(scale AS BIGINT) || 'm_x' || CASE px WHEN 0 THEN '0' ELSE '0.5' END || '_y' || CASE py WHEN 0 THEN '0' ELSE '0.5' END || '_exact'))) AS vv,
  arg_max((score, shared, lift), (score, shared, -scale, -px, -py)) AS best, max(score) AS best_score FROM r GROUP BY a, b),
p AS (SELECT a, b, n_variants, array_to_string(ss, '|') AS scales, array_to_string(vv, '|') AS variants, best_score, best[2] AS best_shared, best[3] AS best_lift, mean_score, (0.7 * best_score + 0.3 * mean_score) * (1 + least(0.5, 0.15 * greatest(0, len(ss) - 1))) AS predictor_score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(predictor_score, 8) DESC, best_shared DESC, best_lift DESC, b) AS rank FROM p)
SELECT a, b, CAST(rank AS INTEGER) AS rank, n_variants, scales, variants, best_shared, round(best_lift, 6) AS best_lift, round(best_score, 6) AS best_score, round(mean_score, 6) AS mean_score, round(predictor_score, 6) AS predictor_score FROM k WHERE rank <= 3""")
def cooccur_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccur.usable(cooccur.presence(V.occ(spark, sf_dir), [(SCALE, 0.0, 0.0), (SCALE, 0.5, 0.5), (900_000.0, 0.0, 0.0)]))
    one = cooccur.collapse(cooccur.associates(found, k=5), k=3)
    return _rounded(one.select("a", "b", "rank", "n_variants", "scales", "variants", "best_shared", "best_lift", "best_score", "mean_score", "predictor_score"))


@query(f"""variants AS (SELECT * FROM (VALUES ({SCALE}, 0.0, 0.0), (900000.0, 0.0, 0.0)) v(scale, px, py)), offsets AS (SELECT 0 AS dx, 0 AS dy), {_ASSOC},
per AS (SELECT scale, px, py, cx, cy, count(*) AS rich FROM pres GROUP BY ALL), np AS (SELECT scale, px, py, count(*) AS pairs FROM pr GROUP BY ALL)
SELECT scale, count(*) FILTER (rich <= 150) AS cells, count(*) FILTER (rich > 150) AS skipped_cells, CAST(coalesce(sum(rich) FILTER (rich <= 150), 0) AS BIGINT) AS kept_records, coalesce(any_value(pairs), 0) AS pairs FROM per LEFT JOIN np USING (scale, px, py) GROUP BY scale""")
def cooccur_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.totals(cooccur.presence(V.occ(spark, sf_dir), [(SCALE, 0.0, 0.0), (900_000.0, 0.0, 0.0)])).drop("px", "py")


@query(f"""variants AS (SELECT {SCALE} AS scale, 0.0 AS px, 0.0 AS py), offsets AS (SELECT * FROM (VALUES (-1), (0), (1)) x(dx) CROSS JOIN (VALUES (-1), (0), (1)) y(dy)), {_ASSOC}
SELECT sid, n AS n_cells FROM cells""")
def cooccur_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccur.usable(cooccur.presence(V.occ(spark, sf_dir), [(SCALE, 0.0, 0.0)], adjacency="moore1"))
    return found.groupBy("sid").agg(F.count("*").alias("n_cells"))


_RANKS = ", ".join(taxonomy.RANKS)
def _level(k: int) -> str:
    path, parent = (" || '/' || ".join(taxonomy.RANKS[:n]) or "''" for n in (k, k - 1))
    return f"SELECT {k} AS rank_id, {path} AS path, {parent} AS parent_path, {taxonomy.RANKS[k - 1]} AS name, count(*) AS obs_count FROM named GROUP BY {', '.join(taxonomy.RANKS[:k])}"


_TREE = f"""named AS (SELECT {", ".join(f"CASE WHEN trim(coalesce({r}, '')) = '' THEN '(missing)' ELSE trim({r}) END AS {r}" for r in taxonomy.RANKS)} FROM occ),
tree AS ({" UNION ALL ".join(map(_level, range(1, 8)))} UNION ALL SELECT 0, '', NULL, 'root', count(*) FROM named)"""


@query(f"{_TREE} SELECT * FROM tree")
def taxonomy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.nodes(V.occ(spark, sf_dir))


@query(f"{_TREE}, c AS (SELECT *, row_number() OVER (ORDER BY obs_count DESC, name) AS position FROM tree WHERE parent_path = 'ASIA') SELECT CAST(position AS INTEGER) AS position, name, rank_id, obs_count FROM c WHERE position > 1 AND position <= 4")
def taxonomy_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.children(taxonomy.nodes(V.occ(spark, sf_dir)), "ASIA", 1, 3)


@query(f"{_TREE}, n7 AS (SELECT DISTINCT {', '.join(taxonomy.RANKS)} FROM named) SELECT '' AS path, (SELECT count(*) FROM n7) AS n_species, count(*) AS n_rows FROM named UNION ALL SELECT 'ASIA', (SELECT count(*) FROM n7 WHERE kingdom = 'ASIA'), count(*) FROM named WHERE kingdom = 'ASIA' UNION ALL SELECT 'ASIA/CHINA', (SELECT count(*) FROM n7 WHERE kingdom = 'ASIA' AND phylum = 'CHINA'), count(*) FROM named WHERE kingdom = 'ASIA' AND phylum = 'CHINA' HAVING count(*) > 0")
def taxonomy_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.under(V.occ(spark, sf_dir), ["ASIA/CHINA", "", "ASIA", "ASIA"])


@query(f"""SELECT {_RANKS}, count(*) AS obs_count FROM occ WHERE (kingdom = 'ASIA' OR lower(genus) = 'brand#11') AND NOT (ord = 'R') GROUP BY ALL HAVING count(*) >= 2""")
def taxonomy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.species_under(V.occ(spark, sf_dir), ["kingdom:Asia", "Brand#11"], ["order=R"], least=2)


@query("""SELECT DISTINCT genus, species, CASE WHEN lower(species) LIKE lower(genus) || ' %' THEN species ELSE genus || ' ' || species END AS label, lower(trim(regexp_replace(species, '\\s+', ' ', 'g'))) AS normal,
regexp_replace(regexp_replace(regexp_replace(trim(genus), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS slug FROM occ""")
def species_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.occ(spark, sf_dir).select("genus", "species").distinct().select("genus", "species", X.species_label(F.col("genus"), F.col("species")).alias("label"), X.normal_text(F.col("species")).alias("normal"), X.slug(F.col("genus")).alias("slug"))


@query("""s AS (SELECT min(species) AS sp FROM occ), p AS (SELECT row_id, species, lon, lat, row_number() OVER (ORDER BY row_id) - 1 AS position FROM occ, s WHERE species = sp)
SELECT CAST(position AS INTEGER) AS position, row_id, species, lon, lat FROM p WHERE position >= 5 AND position < 15""")
def species_rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.occ(spark, sf_dir, row_id=True)
    first = V.table(spark, sf_dir, "lineitem").join(V.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).agg(F.min("p_name")).first()[0]
    return taxonomy.species_page(o, first, 5, 10).select("position", "row_id", "species", "lon", "lat")


@query("SELECT row_id, species, lon, lat FROM occ WHERE row_id >= 100 AND row_id < 150")
def rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.project(ingest.page(V.occ(spark, sf_dir, row_id=True), 100, 50), ["ROW_ID", "species ", "lon", "LAT", "unknown"])


@query("SELECT row_id, grp, unc FROM occ WHERE row_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def rows_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("row_id"))
    return ingest.rows_by_id(V.occ(spark, sf_dir, row_id=True), ids).select("row_id", "grp", "unc")


_DIRTY = "dirty AS (SELECT row_id, CASE WHEN row_id % 13 = 0 THEN 'nan' WHEN row_id % 17 = 0 THEN '95.5' ELSE CAST(lat AS VARCHAR) END AS lat, lon, soilgrids_clay FROM occ)"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.occ(spark, sf_dir, row_id=True)
    return o.select("row_id", F.when(F.col("row_id") % 13 == 0, "nan").when(F.col("row_id") % 17 == 0, "95.5").otherwise(F.col("lat").cast("string")).alias("lat"), "lon", "soilgrids_clay")


@query(f"""{_DIRTY}, f AS (SELECT NOT coalesce(try_cast(lat AS DOUBLE) BETWEEN -90 AND 90 AND NOT isnan(try_cast(lat AS DOUBLE)), false) AS a, soilgrids_clay IS NULL AS b FROM dirty)
SELECT count(*) AS n_read, count(*) FILTER (NOT a AND NOT b) AS n_written, count(*) FILTER (a AND NOT b) AS n_invalid, count(*) FILTER (NOT a AND b) AS n_no_soil, count(*) FILTER (a AND b) AS n_both FROM f""")
def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.drop_counts(_dirty(spark, sf_dir))


@query(f"{_DIRTY} SELECT row_id FROM dirty WHERE NOT isnan(try_cast(lat AS DOUBLE)) AND try_cast(lat AS DOUBLE) BETWEEN -90 AND 90 AND soilgrids_clay IS NOT NULL")
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean(_dirty(spark, sf_dir)).select("row_id")


@query("SELECT grp, count(*) AS n FROM occ WHERE coalesce(unc <= 1000, true) GROUP BY grp")
def uncertainty_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.occ(spark, sf_dir).where(X.within_uncertainty(F.col("unc"), 1000, 1.0)).groupBy("grp").agg(F.count("*").alias("n"))


@query("SELECT grp, count(*) AS n, " + ", ".join(f"arg_min({r}, row_id) AS {r}" for r in taxonomy.RANKS) + " FROM occ GROUP BY grp")
def group_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.group_meta(V.occ(spark, sf_dir, row_id=True))


_COLUMNS = {"dem_elev": "double", "dem_x": "double", "twi_value": "float", "twi_is_nodata": "int", "twi_in_bounds": "int", "mcd12q1_sample_found": "int", "mcd12q1": "int", "dem_continent": "string", "glim_litho": "string", "glim_id": "int", "soilgrids_clay": "double", "terraclimate_ppt_mean": "double", "dem_path": "string", "grp": "string", "lon": "double", "dem_flowdir": "int", "elevation": "double", "soilgrids_year": "int"}


@query("SELECT * FROM (VALUES ('dem_elev', 'numeric'), ('twi_value', 'numeric'), ('soilgrids_clay', 'numeric'), ('terraclimate_ppt_mean', 'numeric'), ('mcd12q1', 'category'), ('dem_continent', 'category'), ('glim_litho', 'category'), ('glim_id', 'category')) v(\"column\", kind)")
def feature_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))
    rows = [(c, "numeric") for c in ingest.numeric_features(df)] + [(c, "category") for c in ingest.categorical_features(df)]
    return spark.createDataFrame(rows, "column string, kind string")


@query("SELECT count(*) FILTER (bad) AS n_missing, count(*) FILTER (soilgrids_clay IS NULL) AS n_soilgrids_clay, count(*) FILTER (terraclimate_ppt_2020_mean IS NULL) AS n_terraclimate_ppt_2020_mean FROM (SELECT *, soilgrids_clay IS NULL OR terraclimate_ppt_2020_mean IS NULL AS bad FROM occ WHERE lat > 0)")
def missing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.missing_results(V.occ(spark, sf_dir), ["soilgrids_clay", "terraclimate_ppt_2020_mean"], F.col("lat") > 0)


@query("""c AS (SELECT CASE WHEN id % 3 = 0 THEN ' ' ELSE 'c' || id END AS own, id AS n, lon, lat FROM grid WHERE id % 10 <> 0), r AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM c)
SELECT CASE WHEN trim(own) = '' THEN 'g' || k ELSE own END AS id, lon, lat FROM r""")
def prepared_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.grid(spark, sf_dir).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, " ").otherwise(F.concat(F.lit("c"), "id")).alias("id"), F.when(F.col("id") % 10 != 0, F.col("lon")).alias("lon"), "lat")
    return ingest.prepared_grid(g, ["n"])


@query("""last AS (SELECT id, max((v, k)) AS s FROM addon GROUP BY id)
SELECT g.id, g.lon, g.lat, round(s[1], 6) AS ord_v, s[2] AS ord_k FROM grid g LEFT JOIN last USING (id)""")
def enrich_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.grid(spark, sf_dir).select("id", "lon", "lat")
    return _rounded(ingest.enrich(g, {"ord": V.addon(spark, sf_dir)}, order={"ord": ["v", "k"]}))


@query("SELECT id, glim_litho, CASE glim_litho WHEN 'A' THEN 'acid' WHEN 'N' THEN 'none' END AS litho_name FROM grid")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("A", "acid"), ("N", "none")], "glim_litho string, litho_name string")
    return V.grid(spark, sf_dir).select("id", "glim_litho").join(F.broadcast(names), "glim_litho", "left").select("id", "glim_litho", "litho_name")


@query("SELECT DISTINCT species || grp || phylum AS species FROM occ WHERE ord = 'A' AND species || grp || phylum NOT IN (SELECT species || grp || phylum FROM occ WHERE class = 'O')")
def new_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.occ(spark, sf_dir).select("ord", "class", F.concat("species", "grp", "phylum").alias("species"))
    return o.where("ord = 'A'").select("species").distinct().join(o.where("class = 'O'").select("species").distinct(), "species", "left_anti")


_BASE_ML = "b AS (SELECT id, lon, lat, dem_elev / 60.0 AS base FROM grid), m AS (SELECT id, lon, lat, CASE WHEN soilgrids_clay = 0 THEN NULL ELSE soilgrids_clay / 12.0 END AS ml FROM grid WHERE glim_litho <> 'R')"


@query(f"""{_BASE_ML} SELECT id, round(base * (0.35 + 0.65 * pow(ml, 0.5)), 6) AS gate, round(0.7 * base + 0.3 * ml, 6) AS mix, round(sqrt(base * greatest(ml, CASE WHEN ml IS NULL THEN NULL ELSE 0.35 END)), 6) AS geo FROM b JOIN m USING (id, lon, lat)""")
def blend_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.grid(spark, sf_dir)
    base = g.select("id", "lon", "lat", (F.col("dem_elev") / 60.0).alias("base"))
    model = g.where("glim_litho <> 'R'").select("id", "lon", "lat", F.when(F.col("soilgrids_clay") != 0, F.col("soilgrids_clay") / 12.0).alias("ml"))
    b, m = F.col("base"), F.col("ml")
    known = m.isNotNull()
    return base.join(model, ["id", "lon", "lat"]).select("id", r6(F.when(known, X.gate(b, m))).alias("gate"), r6(X.mix(b, m)).alias("mix"), r6(F.when(known, X.geometric(b, m))).alias("geo"))


FEATURES = ["dem_elev", "soilgrids_clay", "twi_value"]
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT coalesce(grp, 'NA') AS grp, '{c}' AS \"column\", '{ingest.family(c)}' AS family, {c} AS value FROM occ" for c in FEATURES) + ")"
_STATS = "count(*) AS n_total, count(value) AS n_valid, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*), 6) AS missing_fraction, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(CASE WHEN count(value) > 0 THEN coalesce(stddev_samp(value), 0) END, 6) AS std"


@query(f"""{_LONG} SELECT "column", family, {_STATS} FROM long GROUP BY ALL""")
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.numeric(profile.long(V.occ(spark, sf_dir), FEATURES), ["column", "family"]))


@query(f"""{_LONG} SELECT grp, "column", family, {_STATS} FROM long GROUP BY ALL""")
def profile_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.numeric(profile.long(V.occ(spark, sf_dir), FEATURES, "grp"), ["grp", "column", "family"]))


@query(f"""{_LONG} SELECT grp, round(median(value) FILTER ("column" = 'dem_elev'), 6) AS dem_elev, round(median(value) FILTER ("column" = 'twi_value'), 6) AS twi_value FROM long GROUP BY grp""")
def profile_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.numeric(profile.long(V.occ(spark, sf_dir), ["dem_elev", "twi_value"], "grp"), ["grp", "column"])
    return _rounded(p.groupBy("grp").pivot("column", ["dem_elev", "twi_value"]).agg(F.first("median")))


_FREQ = """vals AS (SELECT grp, 'glim_litho' AS "column", trim(glim_litho) AS value FROM occ UNION ALL SELECT grp, 'mcd12q1', trim(mcd12q1) FROM occ),
cnt AS (SELECT grp, "column", nullif(value, '') AS value, count(*) AS n FROM vals GROUP BY ALL),
freq AS (SELECT *, n / sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) OVER w AS fraction_of_non_null, n / sum(n) OVER w AS fraction_of_all_rows FROM cnt WINDOW w AS (PARTITION BY grp, "column")),
top AS (SELECT *, row_number() OVER (PARTITION BY grp, "column" ORDER BY n DESC, value) AS rk FROM freq WHERE value IS NOT NULL)"""


@query(f"""{_FREQ} SELECT grp, "column", value, n, round(fraction_of_non_null, 6) AS fraction_of_non_null, round(fraction_of_all_rows, 6) AS fraction_of_all_rows FROM top WHERE rk <= 2""")
def category_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.categories(V.occ(spark, sf_dir), ["glim_litho", "mcd12q1"], "grp", top=2))


@query("""vals AS (SELECT 'glim_litho' AS "column", trim(glim_litho) AS value FROM occ UNION ALL SELECT 'mcd12q1', trim(mcd12q1) FROM occ), cnt AS (SELECT "column", nullif(value, '') AS value, count(*) AS n FROM vals GROUP BY ALL)
SELECT "column", value, n, round(n / sum(n) FILTER (value IS NOT NULL) OVER (PARTITION BY "column"), 6) AS fraction_of_non_null, round(n / sum(n) OVER (PARTITION BY "column"), 6) AS fraction_of_all_rows FROM cnt QUALIFY value IS NOT NULL""")
def category_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.categories(V.occ(spark, sf_dir), ["glim_litho", "mcd12q1"]))


@query(f"""{_FREQ}, f AS (SELECT grp, "column", value, fraction_of_non_null AS f FROM top WHERE rk <= 2),
g AS (SELECT * FROM f UNION ALL SELECT grp, "column", '__other__', 1 - sum(f) FROM f GROUP BY grp, "column" HAVING 1 - sum(f) > 1e-9)
SELECT x.grp AS group_a, y.grp AS group_b, x."column", round(sum(least(x.f, y.f)), 6) AS overlap FROM g x JOIN g y ON x."column" = y."column" AND x.value = y.value AND x.grp < y.grp GROUP BY ALL""")
def category_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.category_overlap(profile.categories(V.occ(spark, sf_dir), ["glim_litho", "mcd12q1"], "grp", top=2)))


@query("""v AS (SELECT l_returnflag AS variable, CAST(month(l_shipdate) AS INTEGER) AS month_num, l_extendedprice / 1000 AS value FROM lineitem WHERE month(l_shipdate) <> 3),
s AS (SELECT variable, month_num, count(value) AS n_valid, min(value) AS min, quantile_cont(value, 0.25) AS q25, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, max(value) AS max FROM v GROUP BY ALL),
a AS (SELECT DISTINCT variable, CAST(unnest(range(1, 13)) AS INTEGER) AS month_num FROM s)
SELECT variable, month_num, coalesce(n_valid, 0) AS n_valid, round(min, 6) AS min, round(q25, 6) AS q25, round(mean, 6) AS mean, round(median, 6) AS median, round(q75, 6) AS q75, round(max, 6) AS max FROM a LEFT JOIN s USING (variable, month_num)""")
def profile_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.table(spark, sf_dir, "lineitem").where(F.month("l_shipdate") != 3).select(F.col("l_returnflag").alias("variable"), F.month("l_shipdate").alias("month_num"), (F.col("l_extendedprice") / 1000).alias("value"))
    return _rounded(profile.monthly(v, ["variable"], least_months=6))


_ANOVA = """per AS (SELECT "column", grp, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM long WHERE value IS NOT NULL GROUP BY ALL),
gr AS (SELECT "column", CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, sum(n * m) / sum(n) AS grand, sum(n * v) AS ss_within FROM per GROUP BY 1),
av AS (SELECT g.*, (SELECT sum(p.n * pow(p.m - g.grand, 2)) FROM per p WHERE p."column" = g."column") AS ss_between FROM gr g)"""


@query(f"""{_LONG}, {_ANOVA} SELECT "column", n, groups, round(ss_between, 4) AS ss_between, round(ss_within, 4) AS ss_within, round(ss_between / (ss_between + ss_within), 6) AS eta2, round((ss_between / (groups - 1)) / (ss_within / (n - groups)), 6) AS f_stat FROM av""")
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = profile.anova(profile.long(V.occ(spark, sf_dir), FEATURES, "grp"))
    return a.select("column", "n", "groups", F.round("ss_between", 4).alias("ss_between"), F.round("ss_within", 4).alias("ss_within"), r6("eta2").alias("eta2"), r6("f_stat").alias("f_stat"))


def _iou(lo: str, hi: str) -> str:
    return f"CASE WHEN greatest(a.{hi}, b.{hi}) - least(a.{lo}, b.{lo}) <= 0 THEN 1 ELSE greatest(0, least(a.{hi}, b.{hi}) - greatest(a.{lo}, b.{lo})) / (greatest(a.{hi}, b.{hi}) - least(a.{lo}, b.{lo})) END"


_OVER = f"""prof AS (SELECT grp, "column", family, count(value) AS n_valid, min(value) AS mn, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q75, max(value) AS mx FROM long GROUP BY ALL),
span AS (SELECT "column", max(value) - min(value) AS span FROM long GROUP BY 1),
ov AS (SELECT a.grp AS group_a, b.grp AS group_b, a."column", least(a.n_valid, b.n_valid) AS n_valid_min_pair, {_iou('q25', 'q75')} AS iqr_overlap, {_iou('mn', 'mx')} AS range_overlap,
  CASE WHEN span <= 0 THEN CAST(a.md = b.md AS INTEGER) ELSE greatest(0, 1 - abs(a.md - b.md) / span) END AS center_proximity
  FROM prof a JOIN prof b ON a."column" = b."column" AND a.grp < b.grp JOIN span ON span."column" = a."column" WHERE a.n_valid > 0 AND b.n_valid > 0),
ovf AS (SELECT *, 0.5 * iqr_overlap + 0.3 * range_overlap + 0.2 * center_proximity AS feature_overlap FROM ov)"""


@query(f"""{_LONG}, {_OVER} SELECT group_a, group_b, "column", n_valid_min_pair, round(iqr_overlap, 6) AS iqr_overlap, round(range_overlap, 6) AS range_overlap, round(center_proximity, 6) AS center_proximity, round(feature_overlap, 6) AS feature_overlap FROM ovf""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = profile.long(V.occ(spark, sf_dir), FEATURES, "grp")
    span = v.groupBy("column").agg((F.max("value") - F.min("value")).alias("span"))
    return _rounded(profile.overlap_pairs(profile.numeric(v, ["column", "grp"]), span))


_PRIOR = "CASE family WHEN 'dem' THEN 0.95 WHEN 'twi' THEN 0.9 WHEN 'soilgrids' THEN 0.75 END"
_WEIGHTS = f"""{_LONG}, {_ANOVA}, {_OVER},
md AS (SELECT "column", family, stddev_samp(md) AS b, quantile_cont(q75 - q25, 0.5) AS i FROM prof WHERE n_valid > 0 GROUP BY ALL),
sep AS (SELECT "column", 1 - avg(feature_overlap) AS separation FROM ovf GROUP BY 1),
w0 AS (SELECT av."column", family, ss_between / (ss_between + ss_within) AS eta2, coalesce(b, 0) / greatest(i, greatest(0.05 * span, 1e-9)) AS signal_to_iqr, separation FROM av JOIN md USING ("column") JOIN span USING ("column") LEFT JOIN sep USING ("column")),
w1 AS (SELECT *, (0.35 * eta2 / sum(eta2) OVER () + 0.45 * separation / sum(separation) OVER () + 0.20 * ln(1 + signal_to_iqr) / sum(ln(1 + signal_to_iqr)) OVER ()) * (0.5 + 0.5 * {_PRIOR}) AS raw FROM w0),
wt AS (SELECT "column", family, eta2, signal_to_iqr, separation, raw / sum(raw) OVER () AS blended_weight FROM w1)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.feature_weights(profile.long(V.occ(spark, sf_dir), FEATURES, "grp"))


@query(f"""{_WEIGHTS} SELECT "column", family, round(eta2, 6) AS eta2, round(signal_to_iqr, 6) AS signal_to_iqr, round(separation, 6) AS separation, round(blended_weight, 6) AS blended_weight FROM wt""")
def feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_weights(spark, sf_dir))


@query(f"""{_WEIGHTS} SELECT family, count(*) AS n_features, round(avg(blended_weight), 6) AS mean_weight, round(median(blended_weight), 6) AS median_weight, round(sum(blended_weight), 6) AS sum_weight, round(avg(blended_weight) / sum(avg(blended_weight)) OVER (), 6) AS mean_share, round(sum(blended_weight) / sum(sum(blended_weight)) OVER (), 6) AS share FROM wt GROUP BY 1""")
def family_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.family_weights(_weights(spark, sf_dir)))


_MATRIX = f"""{_WEIGHTS}, mx0 AS (SELECT group_a, group_b, sum(blended_weight * feature_overlap) / sum(blended_weight) AS score FROM ovf JOIN wt USING ("column") GROUP BY ALL),
mx AS (SELECT * FROM mx0 UNION ALL SELECT group_b, group_a, score FROM mx0 UNION ALL SELECT DISTINCT grp, grp, 1.0 FROM prof)"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = profile.long(V.occ(spark, sf_dir), FEATURES, "grp")
    span = v.groupBy("column").agg((F.max("value") - F.min("value")).alias("span"))
    return profile.overlap_matrix(profile.overlap_pairs(profile.numeric(v, ["column", "grp"]), span), profile.feature_weights(v))


@query(f"{_MATRIX} SELECT group_a, group_b, round(score, 6) AS score FROM mx")
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_matrix(spark, sf_dir))


_CATEGORY_PAIRS = f"""{_FREQ}, fq AS (SELECT grp, "column", value, fraction_of_non_null AS f FROM top WHERE rk <= 2),
gq AS (SELECT * FROM fq UNION ALL SELECT grp, "column", '__other__', 1 - sum(f) FROM fq GROUP BY grp, "column" HAVING 1 - sum(f) > 1e-9),
co AS (SELECT x.grp AS group_a, y.grp AS group_b, x."column", sum(least(x.f, y.f)) AS overlap FROM gq x JOIN gq y ON x."column" = y."column" AND x.value = y.value AND x.grp < y.grp GROUP BY ALL)"""


@query(f"""{_MATRIX}, {_CATEGORY_PAIRS}, cm0 AS (SELECT group_a, group_b, avg(overlap) AS score FROM co GROUP BY ALL), cm AS (SELECT * FROM cm0 UNION ALL SELECT group_b, group_a, score FROM cm0),
u AS (SELECT group_a, group_b, score, 0.65 AS s FROM mx UNION ALL SELECT group_a, group_b, score, 0.35 FROM cm)
SELECT group_a, group_b, round(CASE WHEN group_a = group_b THEN 1.0 ELSE sum(score * s) / sum(s) FILTER (score IS NOT NULL) END, 6) AS score FROM u GROUP BY group_a, group_b""")
def blended_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlaps = profile.category_overlap(profile.categories(V.occ(spark, sf_dir), ["glim_litho", "mcd12q1"], "grp", top=2))
    return _rounded(profile.blended(_matrix(spark, sf_dir), profile.category_matrix(overlaps)))


@query(f"""{_WEIGHTS} SELECT group_a || ' | ' || group_b AS pair, family, round(sum(blended_weight * feature_overlap) / sum(blended_weight), 6) AS overlap FROM ovf JOIN wt USING ("column") GROUP BY ALL""")
def family_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = profile.long(V.occ(spark, sf_dir), FEATURES, "grp")
    span = v.groupBy("column").agg((F.max("value") - F.min("value")).alias("span"))
    return _rounded(profile.family_support(profile.overlap_pairs(profile.numeric(v, ["column", "grp"]), span), profile.feature_weights(v)))


@query(f"""{_MATRIX}, t AS (SELECT *, row_number() OVER (PARTITION BY group_a ORDER BY score DESC, group_b) AS rk FROM mx WHERE group_a <> group_b), u AS (SELECT group_a AS grp, 1 / (1 + avg(score)) AS w FROM t WHERE rk <= 3 GROUP BY 1)
SELECT grp, round(w / avg(w) OVER (), 6) AS weight FROM u""")
def redundancy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.redundancy(_matrix(spark, sf_dir)))


@query("""SELECT row_id, round(CASE WHEN terraclimate_ppt_2019_mean IS NULL THEN terraclimate_ppt_2020_mean WHEN terraclimate_ppt_2020_mean IS NULL THEN terraclimate_ppt_2019_mean ELSE (terraclimate_ppt_2019_mean + terraclimate_ppt_2020_mean) / 2 END, 6) AS terraclimate_ppt_mean FROM occ""")
def multi_year_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ingest.fold_years(V.occ(spark, sf_dir, row_id=True)).select("row_id", "terraclimate_ppt_mean"))


# -- suitability ---------------------------------------------------------------------------------------------------------

_TRAP = "CASE WHEN x IS NULL THEN NULL WHEN mx <= mn THEN CASE WHEN abs(x - mn) <= 1e-8 + 1e-5 * abs(mn) THEN 1.0 ELSE 0.0 END WHEN x < mn OR x > mx THEN 0.0 WHEN x >= q25 AND x <= q75 THEN 1.0 WHEN x < q25 THEN (x - mn) / (q25 - mn) ELSE (mx - x) / (mx - q75) END"
_FOLDED = "CASE WHEN terraclimate_ppt_2019_mean IS NULL THEN terraclimate_ppt_2020_mean WHEN terraclimate_ppt_2020_mean IS NULL THEN terraclimate_ppt_2019_mean ELSE (terraclimate_ppt_2019_mean + terraclimate_ppt_2020_mean) / 2 END"
#: With a climate feature whose low side is a stress.
SCORE_FEATURES = [*FEATURES, "terraclimate_ppt_mean"]
_SCORE_LONG = f"{_LONG[:-1]} UNION ALL SELECT coalesce(grp, 'NA'), 'terraclimate_ppt_mean', 'terraclimate', {_FOLDED} FROM occ)"
_SCORE_WEIGHTS = _WEIGHTS.replace(_LONG, _SCORE_LONG).replace(_PRIOR, _PRIOR.replace("END", "WHEN 'terraclimate' THEN 1.0 END"))
_SPAN, _START = "greatest(mx - mn, 1e-12)", "greatest(mn, q25 - 0.15 * greatest(mx - mn, 1e-12))"
_HURT = f"CASE WHEN {_START} - x >= ({_START} - mn) / 1.25 THEN 0.55 ELSE 1 - 0.45 * greatest(0, least(1, 1.25 * ({_START} - x) / greatest({_START} - mn, 0.1 * {_SPAN}))) END"
_DRY = """FILTER (x IS NOT NULL AND "column" = 'terraclimate_ppt_mean')"""
_SCORES = f"""{_SCORE_WEIGHTS},
env AS (SELECT grp, p."column", mn, q25, q75, mx, CASE WHEN blended_weight > 0 THEN blended_weight ELSE 0.8 END AS w0 FROM prof p LEFT JOIN wt USING ("column") WHERE n_valid >= 1),
model AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY grp) AS w FROM env),
x AS ({" UNION ALL ".join(f"SELECT id, glim_litho AS cat, '{c}' AS \"column\", {c} AS x FROM grid" for c in SCORE_FEATURES)}),
sh AS (SELECT grp, glim_litho AS cat, count(*) / sum(count(*)) OVER (PARTITION BY grp) AS f FROM occ GROUP BY grp, glim_litho),
s0 AS (SELECT grp, id, cat, sum(w) FILTER (x IS NOT NULL) AS has, sum(w * ln(greatest(0.02 + 0.98 * pow({_TRAP}, 2), 1e-12))) AS logs,
  sum(w / (1 + greatest(mn - x, x - mx, 0) / greatest(q75 - q25, 0.1 * (mx - mn), 1e-12))) AS rel, sum(w * {_HURT}) {_DRY} AS hurt, sum(w) {_DRY} AS hurt_w FROM model JOIN x USING ("column") GROUP BY grp, id, cat),
s1 AS (SELECT s0.grp, id, exp(logs / has) AS num, (rel + CASE WHEN f > 0 THEN 1 ELSE 0 END) / (has + 1) AS reliability, 0.02 + 0.98 * pow(coalesce(f, 0), 2) AS kat, coalesce(hurt / hurt_w, 1) AS stress_modifier FROM s0 LEFT JOIN sh USING (grp, cat)),
s2 AS (SELECT grp, id, exp(0.85 * ln(greatest(num, 1e-12)) + 0.15 * ln(greatest(kat, 1e-12))) AS core, stress_modifier, reliability, 0.85 + 0.15 * pow(reliability, 0.35) AS factor FROM s1),
sc AS (SELECT *, greatest(0, least(1, core * stress_modifier * factor)) AS adjusted FROM s2)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ingest.fold_years(V.occ(spark, sf_dir))
    groups = profile.of_groups(profile.long(o, SCORE_FEATURES, "grp"))
    envelopes = suitability.models(groups, profile.weights_of(groups))
    shares = profile.categories(o, ["glim_litho"], "grp").select("grp", "value", F.col("fraction_of_non_null").alias("f"))
    return suitability.score(V.grid(spark, sf_dir), envelopes, shares, "glim_litho")


@query(f"""{_SCORES} SELECT grp, id, round(core, 6) AS core, round(stress_modifier, 6) AS stress_modifier, round(reliability, 6) AS reliability, round(factor, 6) AS factor, round(adjusted, 6) AS adjusted FROM sc""")
def suitability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir).select("grp", "id", "core", "stress_modifier", "reliability", "factor", "adjusted"))


@query(f"""{_SCORES} SELECT grp, id, round(CASE WHEN adjusted < 0.3 THEN 0 ELSE adjusted END, 6) AS adjusted FROM sc""")
def suitability_thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir).select("grp", "id", suitability.at_least(F.col("adjusted"), 0.3).alias("adjusted")))


@query(f"""{_SCORES} SELECT grp, count(adjusted) AS n_cells, round(avg(core), 6) AS mean_core, round(avg(adjusted), 6) AS mean_adjusted, round(max(adjusted), 6) AS max_adjusted, count(*) FILTER (adjusted >= 0.5) AS n_suitable, round(count(*) FILTER (adjusted >= 0.5) / count(adjusted), 6) AS fraction_suitable FROM sc GROUP BY grp""")
def suitability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(suitability.summary(_scores(spark, sf_dir)))


@query(f"""{_SCORES}, h AS (SELECT grp, CAST(least(floor(round(adjusted, 9) * 64), 63) AS INTEGER) AS bin, count(*) AS n FROM sc GROUP BY ALL) SELECT grp, bin, n, round(sum(n) OVER (PARTITION BY grp ORDER BY bin) / sum(n) OVER (PARTITION BY grp), 6) AS cdf FROM h""")
def suitability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(suitability.histogram(_scores(spark, sf_dir).withColumn("adjusted", F.round("adjusted", 9)), bins=64))


_JOINT = """v AS (SELECT {k} id, max(adjusted) AS hi, min(adjusted) AS lo, arg_min(grp, (-round(adjusted, 9), grp)) AS top_group, count(*) FILTER (adjusted >= 0.5) AS richness, avg(reliability) AS rel, count(*) AS n, list_sort(list(adjusted)) AS s FROM {t} GROUP BY {k} id),
j AS (SELECT *, CAST(greatest(1, ceil(n * 0.25)) AS INTEGER) AS kk FROM v),
jj AS (SELECT *, 0.7 * lo + 0.3 * list_sum(list_transform(range(1, kk + 1), lambda i: s[i] * pow(i, -1.5))) / list_sum(list_transform(range(1, kk + 1), lambda i: pow(i, -1.5))) AS joint FROM j)"""


@query(f"""{_SCORES}, so AS (SELECT * REPLACE (round(adjusted, 9) AS adjusted) FROM sc), {_JOINT.format(k='', t='so')} SELECT id, round(hi, 6) AS overall_adjusted, round(lo, 6) AS overall_min, top_group, richness, round(rel, 6) AS reliability_mean, round(joint, 6) AS joint FROM jj""")
def suitability_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(suitability.overall(_scores(spark, sf_dir).withColumn("adjusted", F.round("adjusted", 9))))


@query(f"""{_SCORES}, mem AS (SELECT DISTINCT grp, substr(grp, 1, 7) AS rank_value FROM occ), many AS (SELECT rank_value FROM mem GROUP BY 1 HAVING count(DISTINCT grp) > 1), sr AS (SELECT sc.*, rank_value FROM sc JOIN mem USING (grp) JOIN many USING (rank_value)),
{_JOINT.format(k='rank_value,', t='sr')} SELECT rank_value, id, round(lo, 6) AS min_adjusted, round(joint, 6) AS joint_adjusted, round(rel, 6) AS reliability_mean FROM jj""")
def suitability_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = V.occ(spark, sf_dir).select("grp", F.substring("grp", 1, 7).alias("rank_value")).distinct()
    return _rounded(suitability.by_rank(_scores(spark, sf_dir), members))


# -- surfaces --------------------------------------------------------------------------------------------------------------

_CELLS = "cells AS (SELECT ix, iy, CASE WHEN id % 11 = 0 THEN NULL ELSE dem_elev / 60.0 END AS value FROM grid)"
_BLUR = f"""{_CELLS}, blur AS (SELECT a.ix, a.iy, any_value(a.value) AS value, avg(b.value) AS blur, count(b.value) AS near FROM cells a JOIN cells b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY a.ix, a.iy)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.grid(spark, sf_dir).select("ix", "iy", F.when(F.col("id") % 11 != 0, F.col("dem_elev") / 60.0).alias("value"))


@query(f"{_BLUR} SELECT ix, iy, round(value, 6) AS value, round(blur, 6) AS blur, near FROM blur")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(surface.box_filter(_cells(spark, sf_dir)))


@query(f"{_BLUR} SELECT ix, iy, round(value, 6) AS value, round(CASE WHEN value IS NOT NULL THEN blur END, 6) AS value_smooth, round(CASE WHEN value IS NOT NULL THEN greatest(0, least(1, value + 0.6 * (value - blur))) END, 6) AS value_sharpen FROM blur")
def smooth_and_sharpen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(surface.smooth_and_sharpen(_cells(spark, sf_dir)))


@query(f"{_BLUR} SELECT ix, iy, round(coalesce(value, CASE WHEN near >= 5 THEN blur END), 6) AS value FROM blur")
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = surface.fill_holes(_cells(spark, sf_dir))
    return _rounded(dense.join(_cells(spark, sf_dir).select("ix", "iy"), ["ix", "iy"], "left_semi"))


@query(f"{_CELLS} SELECT CAST(floor(ix / 4) AS BIGINT) AS bx, CAST(floor(iy / 4) AS BIGINT) AS by, round(avg(value), 6) AS value, count(value) AS n FROM cells GROUP BY ALL")
def coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(surface.coarsen(_cells(spark, sf_dir), 4))


@query("""v AS (SELECT DISTINCT round(lon, 6) AS v FROM grid), n AS (SELECT v, lag(v) OVER (ORDER BY v) AS p, lead(v) OVER (ORDER BY v) AS q FROM v)
SELECT v, v - coalesce((v - p) / 2, (q - v) / 2) AS low, v + coalesce((q - v) / 2, (v - p) / 2) AS high, (SELECT median(q - v) FROM n) AS step FROM n""")
def axis_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.axis(V.grid(spark, sf_dir), "lon")


_NEAR = """near AS (SELECT o.row_id, arg_min(g.id, (pow(o.lon - g.lon, 2) + pow(o.lat - g.lat, 2), g.id)) AS cell FROM occ o JOIN grid g ON abs(o.lon - g.lon) <= 0.275 AND abs(o.lat - g.lat) <= 0.275
 AND pow(o.lon - g.lon, 2) + pow(o.lat - g.lat, 2) <= 0.275 * 0.275 GROUP BY o.row_id), mapped AS (SELECT o.*, cell FROM occ o LEFT JOIN near USING (row_id))"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.nearest_cell(V.occ(spark, sf_dir, row_id=True), V.grid(spark, sf_dir), 0.275)


@query(f"{_NEAR} SELECT id, count(cell) AS n FROM grid LEFT JOIN mapped ON cell = id GROUP BY id")
def heatmap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.cell_counts(_mapped(spark, sf_dir), V.grid(spark, sf_dir))


@query(f"{_NEAR} SELECT grp, cell AS id, count(*) AS n FROM mapped WHERE cell IS NOT NULL GROUP BY ALL")
def heatmap_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.cell_counts_by_group(_mapped(spark, sf_dir))


@query("SELECT round(lon, 0) AS lon, round(lat, 0) AS lat, round(avg(dem_elev), 6) AS value FROM grid GROUP BY 1, 2")
def regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(surface.regular(V.grid(spark, sf_dir), "dem_elev", 0))


@query(f"{_NEAR} SELECT grp, count(*) AS n_selected, count(cell) AS n_mapped, count(*) - count(cell) AS n_unmapped, round(count(cell) / count(*), 6) AS fraction_mapped FROM mapped GROUP BY grp")
def heatmap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(surface.mapping_summary(_mapped(spark, sf_dir)))


# -- rasters and space -------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.grid(spark, sf_dir).select("id", F.col("lon"), F.col("lat"), F.col("iy").alias("r"), F.col("ix").alias("c"))


def _fallback(radius: int, circle: bool) -> str:
    rows = ", ".join(f"({k + 1}, {dr}, {dc})" for k, (dr, dc) in enumerate(raster.neighbours(radius, circle)))
    return f"""o AS (SELECT * FROM (VALUES (0, 0, 0), {rows}) v(k, dr, dc)), pt AS (SELECT id, iy AS r, ix AS c FROM grid),
    hit AS (SELECT id, min((k, value)) AS b FROM pt, o, raster z WHERE z.r = pt.r + dr AND z.c = pt.c + dc AND value IS NOT NULL GROUP BY id)
    SELECT id, CAST(b[1] AS INTEGER) AS found, b[2] AS value FROM pt LEFT JOIN hit USING (id)"""


@query(_fallback(1, False))
def sample_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.sample(_points(spark, sf_dir), V.raster(spark, sf_dir), 1).select("id", "found", "value")


@query(_fallback(2, True))
def sample_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.sample(_points(spark, sf_dir), V.raster(spark, sf_dir), 2, round_window=True).select("id", "found", "value")


@query("p AS (SELECT id, CAST(floor((52.5 - lat) / 0.3) AS BIGINT) AS r, CAST(floor((lon + 120) / 0.4) AS BIGINT) AS c FROM grid) SELECT id, p.r, p.c, value FROM p LEFT JOIN raster z ON z.r = p.r AND z.c = p.c")
def pixel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster.to_pixel(V.grid(spark, sf_dir).select("id", "lon", "lat"), -120.0, 52.5, 0.4, 0.3)
    return raster.sample(p, V.raster(spark, sf_dir)).select("id", "r", "c", "value")


@query("SELECT row_id, CASE " + " ".join(f"WHEN lon BETWEEN {a} AND {c} AND lat BETWEEN {b} AND {d} THEN '{n}'" for n, a, b, c, d in raster.CONTINENTS) + " END AS continent, 'x' || CAST(floor(lon / 5) * 5 AS BIGINT) || '_y' || CAST(floor(lat / 5) * 5 AS BIGINT) AS tile_key FROM occ")
def continent_and_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.tile_key(raster.first_box(V.occ(spark, sf_dir, row_id=True))).select("row_id", "continent", "tile_key")


_MANIFEST = {"continents": {"af": {"big": {"flowacc": {"bounds_wgs84": [-20, -36, 55, 38]}}}, "eu": {"big": {"dem": {"bounds_wgs84": [-25, 34, 60, 72]}}}, "as": {"big": {"dem": {"bounds_wgs84": [55, -12, 180, 82]}, "flowdir": {"bounds_wgs84": [50, -12, 180, 82]}}}, "sa": {"big": {}}}}
_BOXES = raster.manifest_boxes(_MANIFEST, ["af", "as", "eu", "sa"])


@query("SELECT row_id, CASE " + " ".join(f"WHEN lon BETWEEN {a} AND {c} AND lat BETWEEN {b} AND {d} THEN '{n}'" for n, a, b, c, d in [("as", 55, -12, 180, 82), ("eu", -25, 34, 60, 72), ("af", -20, -36, 55, 38), ("as", 50, -12, 180, 82)]) + " END AS continent FROM occ")
def continent_of_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.first_box(V.occ(spark, sf_dir, row_id=True), _BOXES).select("row_id", "continent")


_TILES = [(i, (i * 7) % 30, (i * 11) % 40, (i * 7) % 30 + 12, (i * 11) % 40 + 9) for i in range(1, 25)]


@query(f"t AS (SELECT * FROM (VALUES {', '.join(map(str, _TILES))}) v(tile, r0, c0, r1, c1)) SELECT p.id, CAST(min(tile) AS BIGINT) AS tile FROM (SELECT id, iy AS r, ix AS c FROM grid) p LEFT JOIN t ON p.r >= r0 AND p.r < r1 AND p.c >= c0 AND p.c < c1 GROUP BY p.id")
def tile_of_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = spark.createDataFrame(_TILES, "tile long, r0 long, c0 long, r1 long, c1 long")
    return raster.tile_of_block(_points(spark, sf_dir), tiles, 8).select("id", "tile")


@query("SELECT CAST(floor(r / 5) AS BIGINT) AS tr, CAST(floor(c / 5) AS BIGINT) AS tc, count(*) AS n, round(count(value) / count(*), 6) AS ratio FROM raster GROUP BY ALL HAVING count(value) / count(*) >= 0.8")
def valid_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.valid_ratio(V.raster(spark, sf_dir), 5, 0.8))


_M = ["dem_elev", "soilgrids_clay", "twi_value", "terraclimate_ppt_2019_mean", "terraclimate_ppt_2020_mean"]


@query(f"SELECT row_id, round(list_avg(l) + 1e-9, 6) AS m_mean, round(list_sum(l) + 1e-9, 6) AS m_sum, round(list_min(l), 6) AS m_min, round(list_max(l), 6) AS m_max FROM (SELECT row_id, list_filter([{', '.join(_M)}], lambda x: x IS NOT NULL) AS l FROM occ)")
def month_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = raster.months(V.occ(spark, sf_dir, row_id=True), _M)
    return m.select("row_id", r6(F.col("m_mean") + 1e-9).alias("m_mean"), r6(F.col("m_sum") + 1e-9).alias("m_sum"), r6("m_min").alias("m_min"), r6("m_max").alias("m_max"))  # away from ties


@query("SELECT id, round(cos(radians(dem_elev * 6)), 6) AS northness, round(sin(radians(dem_elev * 6)), 6) AS eastness, round(ln((greatest(terraclimate_ppt_mean, 0) + 1) / greatest(tan(radians(twi_value)), 1e-6)), 6) AS twi FROM grid")
def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.grid(spark, sf_dir)
    return g.select("id", r6(X.northness(F.col("dem_elev") * 6)).alias("northness"), r6(X.eastness(F.col("dem_elev") * 6)).alias("eastness"), r6(X.wetness_index(F.col("twi_value"), F.col("terraclimate_ppt_mean"))).alias("twi"))


_RING = [(0.3, 0.2), (9.7, 1.1), (7.9, 8.3), (4.2, 4.9), (1.1, 9.4)]
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_RING, [*_RING[1:], _RING[0]]))


@query(f"""p AS (SELECT i AS ix, j AS iy, 0.25 + 0.5 * i AS x, 0.25 + 0.5 * j AS y FROM range(20) a(i), range(20) b(j)), e AS (SELECT * FROM (VALUES {_EDGES}) v(ax, ay, cx, cy))
SELECT ix, iy, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM p, e GROUP BY ix, iy, x, y HAVING count(*) FILTER ((ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / (cy - ay) + ax) % 2 = 1""")
def lattice_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.inside(space.lattice(spark, 0.0, 0.0, 10.0, 10.0, 0.5), _RING)


@query("""pos AS (SELECT DISTINCT CAST(floor(lon / 2) AS BIGINT) AS bx, CAST(floor(lat / 2) AS BIGINT) AS by FROM grid WHERE dem_elev = 0 AND soilgrids_clay = 0)
SELECT id FROM grid g WHERE NOT EXISTS (SELECT 1 FROM pos WHERE abs(pos.bx - floor(g.lon / 2)) <= 1 AND abs(pos.by - floor(g.lat / 2)) <= 1)""")
def background_outside_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.grid(spark, sf_dir)
    return space.outside_buffer(g.select("id", "lon", "lat"), g.where("dem_elev = 0 and soilgrids_clay = 0"), 2.0, 1).select("id")


# -- models ------------------------------------------------------------------------------------------------------------------

_SCORED = "scored AS (SELECT row_id, CAST(ord = 'A' AS BIGINT) AS y, CASE ord WHEN 'A' THEN (row_id * 37 % 100 + 20) / 121.0 ELSE (row_id * 53 % 100) / 121.0 END AS p FROM occ)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.occ(spark, sf_dir, row_id=True)
    p = F.when(F.col("ord") == "A", (F.col("row_id") * 37 % 100 + 20) / 121.0).otherwise((F.col("row_id") * 53 % 100) / 121.0)
    return o.select("row_id", (F.col("ord") == "A").cast("long").alias("y"), p.alias("p"))


@query(f"""{_SCORED}, a AS (SELECT sum(y) AS pos, sum(1 - y) AS neg, avg(-y * ln(greatest(p, 1e-15)) - (1 - y) * ln(1 - p)) AS logloss, avg(pow(p - y, 2)) AS brier, sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN 1 - y ELSE 0 END) AS fp FROM scored),
per AS (SELECT p AS s, sum(y) AS p1, sum(1 - y) AS p0 FROM scored GROUP BY 1), run AS (SELECT *, sum(p1) OVER (ORDER BY s DESC) AS tpr, sum(p0) OVER (ORDER BY s DESC) AS fpr FROM per),
b AS (SELECT sum((tpr - p1 / 2) * p0) AS auc, sum(p1 * tpr / (tpr + fpr)) AS ap FROM run)
SELECT round(auc / (pos * neg), 6) AS roc_auc, round(ap / pos, 6) AS pr_auc, round(logloss, 6) AS logloss, round(brier, 6) AS brier, round((tp + neg - fp) / (pos + neg), 6) AS accuracy, round((tp / pos + (neg - fp) / neg) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / pos, 6) AS recall, round(2 * tp / (2 * tp + fp + pos - tp), 6) AS f1 FROM a, b""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.binary_metrics(_scored(spark, sf_dir)))


@query(f"""{_SCORED}, t AS (SELECT round(0.05 + 0.025 * i, 3) AS t FROM range(37) r(i)), f AS (SELECT t, sum(CASE WHEN p >= t THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= t THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN p < t THEN y ELSE 0 END) AS fn FROM scored, t GROUP BY t)
SELECT CAST(arg_max(t, (2 * tp / (2 * tp + fp + fn), -t)) AS DOUBLE) AS t, round(max(2 * tp / (2 * tp + fp + fn)), 6) AS f1 FROM f""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.best_threshold(_scored(spark, sf_dir)).select("t", r6("f1").alias("f1"))


@query("SELECT ord AS label, count(*) AS n, round((SELECT count(*) FROM occ) / (3.0 * count(*)), 6) AS weight FROM occ GROUP BY ord")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.class_weights(V.occ(spark, sf_dir), "ord"))


@query("""c AS (SELECT ord AS label, CASE WHEN class = 'F' THEN 'A' ELSE 'N' END AS predicted, count(*) AS n FROM occ GROUP BY ALL), r AS (SELECT label, sum(n) AS support, sum(CASE WHEN label = predicted THEN n ELSE 0 END) AS tp FROM c GROUP BY 1), q AS (SELECT predicted AS label, sum(n) AS called FROM c GROUP BY 1),
m AS (SELECT label, CAST(support AS BIGINT) AS support, coalesce(tp / called, 0) AS p, tp / support AS r FROM r LEFT JOIN q USING (label))
SELECT label, support, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.multiclass_metrics(V.occ(spark, sf_dir).select(F.col("ord").alias("label"), F.when(F.col("class") == "F", "A").otherwise("N").alias("predicted"))))


@query("v AS (SELECT unnest(['dem_elev', 'same', 'twi_value']) AS \"column\", unnest([var_pop(dem_elev), var_pop(0.5), var_pop(twi_value)]) AS variance FROM occ) SELECT \"column\", round(variance, 6) AS variance, variance > 1e-10 AS kept FROM v")
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.variances(V.occ(spark, sf_dir).withColumn("same", F.lit(0.5)), ["dem_elev", "same", "twi_value"]))


_CLASSES = (("A", 37), ("N", 53), ("R", 71), ("Z", 89))


def _class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.occ(spark, sf_dir, row_id=True)
    raw = [(F.lit(c), F.col("row_id") * k % 100 + F.lit(1.0)) for c, k in _CLASSES]
    return o.select("row_id", F.col("ord").alias("label"), F.create_map(*(x for kv in raw for x in kv)).alias("probs"))


_MULTI = f"""raw AS (SELECT row_id, ord AS label, unnest({[c for c, _ in _CLASSES]}) AS c, unnest([{', '.join(f'row_id * {k} % 100 + 1.0' for _, k in _CLASSES)}]) AS v FROM occ),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, c) AS k, v / sum(v) OVER (PARTITION BY row_id) AS p FROM raw),
one AS (SELECT row_id, label, max(c) FILTER (k = 1) AS predicted, max(k) FILTER (c = label) <= 3 AS near, max(p) FILTER (c = label) AS p FROM rk GROUP BY row_id, label),
per AS (SELECT c, count(*) FILTER (label = c) AS own, count(*) FILTER (predicted = c) AS called, count(*) FILTER (label = c AND predicted = c) AS tp FROM one, (SELECT DISTINCT c FROM raw) GROUP BY c HAVING own + called > 0),
fig AS (SELECT *, coalesce(tp / nullif(called, 0), 0) AS pr, coalesce(tp / nullif(own, 0), 0) AS re FROM per)"""


@query(f"""{_MULTI} SELECT count(*) AS n, round(avg(CAST(label = predicted AS DOUBLE)), 6) AS accuracy, round(avg(CAST(near AS DOUBLE)), 6) AS top3_accuracy, round(avg(-ln(p)), 6) AS logloss, (SELECT round(avg(re) FILTER (own > 0), 6) FROM fig) AS balanced_accuracy,
(SELECT round(avg(pr), 6) FROM fig) AS macro_precision, (SELECT round(avg(re), 6) FROM fig) AS macro_recall, (SELECT round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 6) FROM fig) AS macro_f1 FROM one""")
def multiclass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.multiclass_summary(_class_rows(spark, sf_dir)))


@query("""e AS (SELECT row_id, greatest(row_id % 10 / 10.0, 1e-6) AS a, greatest(row_id % 7 / 7.0, 1e-6) AS n FROM occ) SELECT row_id, round(a / (a + n + 1e-6), 6) AS a, round(n / (a + n + 1e-6), 6) AS n, round(1e-6 / (a + n + 1e-6), 6) AS r FROM e""")
def expanded_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.occ(spark, sf_dir, row_id=True).select("row_id", F.create_map(F.lit("A"), F.col("row_id") % 10 / F.lit(10.0), F.lit("N"), F.col("row_id") % 7 / F.lit(7.0)).alias("p"))
    full = rows.select("row_id", ml.expanded(F.col("p"), ["A", "N", "R"]).alias("q"))
    return _rounded(full.select("row_id", F.col("q")["A"].alias("a"), F.col("q")["N"].alias("n"), F.col("q")["R"].alias("r")))


def _spec(spark: SparkSession, sf_dir: str, values: int) -> dict:
    o = V.occ(spark, sf_dir)
    return ml.choose_features(o, V.grid(spark, sf_dir), profile.categories(o, ["glim_litho", "mcd12q1"], "grp"), {"twi_value": 0.5}, values=values)


@query("SELECT id, twi_value, dem_elev, soilgrids_clay, CAST(glim_litho = 'A' AS INTEGER) AS glim_litho__a, CAST(glim_litho = 'N' AS INTEGER) AS glim_litho__n, CAST(glim_litho = 'R' AS INTEGER) AS glim_litho__r FROM grid")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.grid(spark, sf_dir)
    return g.select("id", *(c.alias(n) for n, c in ml.feature_columns(g, _spec(spark, sf_dir, 12)).items()))


@query(f"""{_FREQ}, v AS (SELECT lower(value) AS value, max(fraction_of_non_null) AS f FROM top WHERE "column" = 'glim_litho' AND rk <= 50 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY f DESC, value) AS k FROM v)
SELECT 'category' AS kind, 'glim_litho' AS "column", CAST(k AS INTEGER) AS place, value FROM r WHERE k <= 2 UNION ALL SELECT 'numeric', unnest(['twi_value', 'dem_elev', 'soilgrids_clay']), unnest([1, 2, 3]), NULL""")
def chosen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _spec(spark, sf_dir, 2)
    rows = [("numeric", c, k + 1, None) for k, c in enumerate(spec["numeric"])] + [("category", c, k + 1, v) for c, vs in spec["vocabulary"].items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "kind string, column string, place int, value string")


@query("""b AS (SELECT CAST(floor(lon / 30) AS BIGINT) AS bx, CAST(floor(lat / 30) AS BIGINT) AS b_y, count(*) AS n, count(*) FILTER (ord = 'A') AS pos FROM occ GROUP BY ALL), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, bx, b_y) - 1 AS k FROM b),
f AS (SELECT CAST(CASE WHEN floor(k / 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n, sum(pos) AS pos FROM p GROUP BY 1)
SELECT fold, n, round(n / (SELECT sum(n) FROM f), 6) AS share FROM f WHERE pos > 0 AND pos < n ORDER BY abs(n / (SELECT sum(n) FROM f) - 0.2), fold LIMIT 1""")
def calibration_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ml.folds(V.occ(spark, sf_dir).select("lon", "lat", (F.col("ord") == "A").cast("long").alias("y")), 30.0)
    return _rounded(ml.calibration_fold(f))


@query("""r AS (SELECT corr(terraclimate_ppt_2019_mean, terraclimate_ppt_2020_mean) AS a, corr(terraclimate_ppt_2019_mean, dem_elev) AS b, corr(terraclimate_ppt_2020_mean, dem_elev) AS c FROM occ)
SELECT 'terraclimate_ppt_2019_mean' AS one, 'terraclimate_ppt_2020_mean' AS two, round(a, 6) AS r, abs(a) > 0.98 AS dropped FROM r UNION ALL SELECT 'terraclimate_ppt_2019_mean', 'dem_elev', round(b, 6), abs(b) > 0.98 FROM r UNION ALL SELECT 'terraclimate_ppt_2020_mean', 'dem_elev', round(c, 6), abs(c) > 0.98 FROM r""")
def correlation_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.correlations(V.occ(spark, sf_dir), ["terraclimate_ppt_2019_mean", "terraclimate_ppt_2020_mean", "dem_elev"]))


@query("""c AS (SELECT ord, count(*) AS n FROM occ GROUP BY 1), q AS (SELECT ord, greatest(1, floor(500 * n / sum(n) OVER ())) AS quota FROM c), r AS (SELECT row_id, ord, row_number() OVER (PARTITION BY ord ORDER BY md5(row_id || '|42'), row_id) AS rk FROM occ)
SELECT row_id, r.ord FROM r JOIN q USING (ord) WHERE rk <= quota AND rk <= 500""")
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.capped(V.occ(spark, sf_dir, row_id=True).select("row_id", "ord"), "ord", "row_id", 500).select("row_id", "ord")


@query("SELECT row_id, species FROM (SELECT *, row_number() OVER (PARTITION BY species, round(lon, 0), round(lat, 0) ORDER BY row_id) AS k FROM occ) WHERE k = 1")
def one_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.one_per_place(V.occ(spark, sf_dir, row_id=True).select("species", "lon", "lat", "row_id"), ["species"], "row_id", digits=0).select("row_id", "species")


@query("""b AS (SELECT CAST(floor(lon / 30) AS BIGINT) AS bx, CAST(floor(lat / 30) AS BIGINT) AS b_y, count(*) AS n FROM occ GROUP BY ALL), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, bx, b_y) - 1 AS k FROM b)
SELECT CAST(CASE WHEN floor(k / 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks FROM p GROUP BY 1""")
def spatial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ml.folds(V.occ(spark, sf_dir).select("lon", "lat"), 30.0)
    return f.select("fold", *space.block(30.0)).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("bx", "by").alias("blocks"))


_SHARES = "sh0 AS (SELECT row_id % 200 AS id, grp, count(*) AS n FROM occ GROUP BY 1, 2), sh AS (SELECT id, grp, n / sum(n) OVER (PARTITION BY id) AS share FROM sh0)"


@query(f"""{_SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, grp) AS k FROM sh)
SELECT id, any_value(grp) FILTER (k = 1) AS top_group, round(max(share), 6) AS top_share, any_value(grp) FILTER (k = 2) AS second_group, round(max(share) - max(share) FILTER (k = 2), 6) AS gap, count(*) FILTER (share >= 0.05) AS n_above, round(1 / sum(share * share), 6) AS effective_richness FROM r GROUP BY id""")
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.community(_shares(spark, sf_dir), 0.05))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = V.occ(spark, sf_dir, row_id=True).groupBy((F.col("row_id") % 200).alias("id"), "grp").agg(F.count("*").alias("n"))
    return n.select("id", "grp", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("share"))


@query(f"""{_SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, grp) AS k FROM sh)
SELECT grp, round(sum(share) / (SELECT count(DISTINCT id) FROM sh), 6) AS mean_share, round(max(share), 6) AS max_share, count(*) FILTER (k = 1) AS top_wins, count(*) FILTER (share >= 0.05) AS n_above FROM r GROUP BY grp""")
def community_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.community_groups(_shares(spark, sf_dir), 0.05))


_CONS = "{c} AS (SELECT quantile_cont({f}, 0.1) AS a, quantile_cont({f}, 0.25) AS b, quantile_cont({f}, 0.5) AS m, quantile_cont({f}, 0.75) AS d, quantile_cont({f}, 0.9) AS e, stddev_pop({f}) AS s FROM occ WHERE ord = 'A')"


def _cons_sql() -> str:
    parts = []
    for c, f in (("qa", "dem_elev"), ("qb", "twi_value")):
        sp = f"greatest({c}.e - {c}.a, {c}.d - {c}.b, {c}.s, 1e-6)"
        parts.append((f"1 / (1 + pow(abs(g.{f} - {c}.m) / greatest(1.5 * ({c}.d - {c}.b), 0.35 * {sp}, 1e-6), 1.6))", f"least(greatest({c}.a - 0.15 * {sp} - g.{f}, g.{f} - {c}.e - 0.15 * {sp}, 0) / {sp}, 6)"))
    return f"""{_CONS.format(c='qa', f='dem_elev')}, {_CONS.format(c='qb', f='twi_value')}, k AS (SELECT id, g.soilgrids_clay / 12.0 AS raw, (2 * {parts[0][0]} + {parts[1][0]}) / 3 AS center, exp(-1.75 * (2 * {parts[0][1]} + {parts[1][1]}) / 3) AS novelty FROM grid g, qa, qb)
    SELECT id, round(raw, 6) AS raw, round(center, 6) AS center, round(novelty, 6) AS novelty, round(pow(raw, 1.1) * (0.4 + 0.6 * pow(center, 1.25)) * (0.08 + 0.92 * novelty), 6) AS adjusted FROM k"""


@query(_cons_sql())
def conservative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = V.grid(spark, sf_dir).withColumn("p", F.col("soilgrids_clay") / 12.0)
    return _rounded(ml.conservative(cells, V.occ(spark, sf_dir).where("ord = 'A'"), ["dem_elev", "twi_value"], weights={"dem_elev": 2.0, "twi_value": 1.0}))


@query()
def presence_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest's presence scores on the lattice; rows only, as its numbers are the library's own."""
    rows = V.occ(spark, sf_dir).select((F.col("ord") == "A").cast("double").alias("y"), *FEATURES)
    cells = V.grid(spark, sf_dir).select("id", *FEATURES)
    return ml.predict(ml.fit_presence(rows, FEATURES), cells).select("id", r6("p").alias("p"))


# -- append, export, sets ----------------------------------------------------------------------------------------------------

_APPEND = """old AS (SELECT row_number() OVER (ORDER BY row_id) AS id, row_id, species FROM occ WHERE ord = 'A'),
new AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY row_id) AS id, row_id, species FROM occ WHERE ord <> 'A' AND species || grp NOT IN (SELECT species || grp FROM occ WHERE ord = 'A'))"""


@query(f"{_APPEND} SELECT id, row_id, species FROM old UNION ALL SELECT id, row_id, species FROM new")
def append_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    from biotope.streaming.append import appended

    o = V.occ(spark, sf_dir, row_id=True).select("row_id", "ord", F.concat("species", "grp").alias("key"), "species")
    old = ingest.with_row_ids(o.where("ord = 'A'").drop("ord").withColumnRenamed("row_id", "source_row"), ["source_row"], start=1).withColumnRenamed("row_id", "id")
    new = o.where("ord <> 'A'").drop("ord").withColumnRenamed("row_id", "source_row")
    return appended(old, new, "key", ["source_row"]).select("id", F.col("source_row").alias("row_id"), "species")


@query("SELECT kingdom, phylum, species, kingdom || '/' || phylum || '/' || regexp_replace(species, '[\\\\/:*?\"<>|]+', '_', 'g') AS folder, count(*) AS n FROM occ WHERE kingdom = 'ASIA' GROUP BY ALL")
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.occ(spark, sf_dir).where("kingdom = 'ASIA'").groupBy("kingdom", "phylum", "species").agg(F.count("*").alias("n"))
    return o.withColumn("folder", F.concat_ws("/", *(X.path_part(F.col(c)) for c in ("kingdom", "phylum", "species"))))


@query("SELECT DISTINCT species FROM occ WHERE ord = 'A' AND species IN (SELECT species FROM occ WHERE ord = 'N') AND species NOT IN (SELECT species FROM occ WHERE ord = 'R' AND genus = 'Brand#11' AND species IS NOT NULL)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.occ(spark, sf_dir)
    both = o.where("ord = 'A'").select("species").intersect(o.where("ord = 'N'").select("species"))
    return both.exceptAll(o.where("ord = 'R' and genus = 'Brand#11'").select("species").distinct())
