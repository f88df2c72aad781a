"""Every registered query with oracle SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from opsloom.plans import operations  # noqa: F401  registers its queries
from opsloom.plans.registry import FLAGSHIP, ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    picked = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert rows_of(got.select(*columns).collect()) == rows_of(picked)
