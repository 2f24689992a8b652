"""Every registered query of the engine against its SQL, at the smallest size."""

import os

import duckdb
import pytest

from semafold import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, int | str | bool | None) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in (x.asDict(True) for x in frame.collect()))
    held = duck.sql(registry.oracle_sql()[name])
    assert sorted(held.columns) == columns
    want = sorted(repr([plain(dict(zip(held.columns, r, strict=True))[c]) for c in columns]) for r in held.fetchall())
    assert got == want
