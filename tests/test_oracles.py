"""Every registered query of the time-series engine against its DuckDB SQL."""

import math

import duckdb
import pytest

from tidewright import catalog

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


def rows(records, columns):
    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x

    return sorted((tuple(cell(r[c]) for c in columns) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, AT)
    found = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(got.columns) == sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert rows(got.toArrow().to_pylist(), sorted(names)) == rows(want, sorted(names))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, AT).count() > 0
