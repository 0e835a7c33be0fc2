"""Every query with SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf)
    rel = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in rel.fetchall()), key=repr)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    assert mine == want


#: Held against brute force or golden values in test_parsers.
PARSERS = {"chunks", "html_extract", "html_metadata"}


def test_every_other_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == PARSERS


def test_scopes_are_neither_empty_nor_all(spark, sf):
    every, some = (registry.queries()[n](spark, sf).count() for n in ("bm25_all", "scoped_bm25"))
    assert 0 < some < every and registry.queries()["scoped_retrieve"](spark, sf).count() > 5
