"""Every query against its DuckDB SQL, at the smallest size."""

import math

import pytest
from conftest import SF

from biotope.plans.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(f"select * from ({ORACLES[name]})")
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(([plain(r[i]) for i in order] for r in rel.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-6) if all(isinstance(x, float) for x in g) else all(x == y or (isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) < 2e-6) for x, y in zip(g, w)), (g, w)
