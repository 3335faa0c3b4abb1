"""Registered queries against their SQL at the smallest scale."""

from decimal import Decimal

import duckdb
import pytest

from barloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def _plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, int | float | Decimal) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told = db.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    key = lambda row: [str(x) for x in row]
    got = sorted(([_plain(r[c]) for c in sorted(names)] for r in df.collect()), key=key)
    want = sorted(([_plain(r[names.index(c)]) for c in sorted(names)] for r in told.fetchall()), key=key)
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
