"""Stand-in tables: occurrences, a lattice, a raster and an add-on table, made from the driver's tables; the same SQL serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: All columns of occ but row_id.
_OCC = """
select r.r_name as kingdom, n.n_name as phylum, l.l_linestatus as class, l.l_returnflag as ord, p.p_type as family,
       p.p_brand as genus, p.p_name as species, p.p_brand as grp,
       cast((l.l_orderkey * 7919) % 36000 as double) / 100.0 - 180.0 as lon,
       cast((l.l_orderkey * 104729 + l.l_linenumber * 131) % 17000 as double) / 100.0 - 85.0 as lat,
       case when l.l_linenumber % 5 = 0 then cast(null as double) else cast(l.l_orderkey % 3000 as double) end as unc,
       l.l_quantity as dem_elev,
       case when l.l_linenumber = 2 then cast(null as double) else l.l_discount * 100.0 end as soilgrids_clay,
       l.l_tax * 100.0 as twi_value,
       l.l_extendedprice / 1000.0 as terraclimate_ppt_2019_mean,
       case when l.l_orderkey % 7 = 0 then cast(null as double) else l.l_extendedprice / 1100.0 end as terraclimate_ppt_2020_mean,
       l.l_returnflag as glim_litho, l.l_linestatus as mcd12q1,
       l.l_orderkey as k1, l.l_linenumber as k2, l.l_partkey as k3, l.l_suppkey as k4, l.l_extendedprice as k5, l.l_quantity as k6,
       l.l_discount as k7, l.l_tax as k8, l.l_shipdate as k9
from {lineitem} l
join {part} p on l.l_partkey = p.p_partkey
join {supplier} s on l.l_suppkey = s.s_suppkey
join {nation} n on s.s_nationkey = n.n_nationkey
join {region} r on n.n_regionkey = r.r_regionkey
"""
KEYS = [f"k{i}" for i in range(1, 10)]

_GRID = """
select c_custkey as id, cast(c_custkey % 40 as bigint) as ix, cast(floor(c_custkey / 40.0) as bigint) as iy,
       cast(-120.0 + (c_custkey % 40) * 0.5 as double) as lon, cast(40.0 + floor(c_custkey / 40.0) * 0.25 as double) as lat,
       cast(c_custkey * 13 % 60 as double) as dem_elev, cast(c_custkey * 7 % 12 as double) as soilgrids_clay,
       cast(c_custkey * 5 % 10 as double) as twi_value, c_acctbal / 100.0 as terraclimate_ppt_mean,
       case when c_custkey % 3 = 0 then 'A' when c_custkey % 3 = 1 then 'N' else 'R' end as glim_litho
from {customer}
"""

_RASTER = """
select 'demo' as layer, 1 as band, cast(floor(p_partkey / 50.0) as bigint) as r, cast(p_partkey % 50 as bigint) as c,
       case when p_size % 7 = 0 then cast(null as double) else p_retailprice end as value
from {part}
"""

_ADDON = "select o_orderkey as id, o_totalprice as v, o_orderpriority as k from {orders} where o_orderkey % 4 <> 0"

_TABLES = "region nation customer supplier part orders lineitem events".split()


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}))


def occ(spark: SparkSession, sf_dir: str, row_id: bool = False) -> DataFrame:
    """Occurrences; with row_id, numbered from 0 in the order of their keys."""
    from biotope.operators.ingest import with_row_ids

    rows = _run(spark, sf_dir, _OCC)
    return with_row_ids(rows, KEYS).drop(*KEYS) if row_id else rows.drop(*KEYS)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _GRID)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _RASTER)


def addon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _ADDON)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(text: str) -> str:
    """DuckDB SQL with the stand-in tables before it; text begins with further "name AS (...)," or with SELECT."""
    own = {t: t for t in _TABLES}
    occ_ = f"select cast(row_number() over (order by {', '.join(KEYS)}) - 1 as bigint) as row_id, * exclude ({', '.join(KEYS)}) from ({_OCC.format(**own)})"
    head = f"WITH occ AS ({occ_}), grid AS ({_GRID.format(**own)}), raster AS ({_RASTER.format(**own)}), addon AS ({_ADDON.format(**own)})"
    text = text.strip()
    return f"{head} {text}" if text[:6].lower() == "select" else f"{head}, {text}"
