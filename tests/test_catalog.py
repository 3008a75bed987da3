"""Every catalogue query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog, catalog_records, catalog_stores  # noqa: F401  the others add their queries to the first's registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows):
    fix = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, folder, name):
    got = catalog.QUERIES[name](spark, folder)
    want = duck.sql(catalog.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    duck.sql(catalog.ORACLE[name]).create(f"t_{name}")
    assert plain(map(tuple, got.select(*names).collect())) == plain(duck.sql(f"SELECT {quoted} FROM t_{name}").fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() > 0
