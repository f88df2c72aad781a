"""Every registered report against DuckDB; each has rows, so that none agrees by being empty."""

import duckdb
import pytest

from opsloom.plans import reports  # noqa: F401  registers its queries
from opsloom.plans.registry import ORACLES, QUERIES


def rows_of(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("report_")))
def test_report_against_oracle(name, spark, sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    expected = rows_of(want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert expected
    assert rows_of(got.select(*columns).collect()) == expected
