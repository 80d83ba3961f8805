"""Every registered transit query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tramline.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rounded(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, str(DATA))
    asked = duck.sql(registry.oracle_sql()[name])
    assert {c: TYPES.get(t, t) for c, t in found.dtypes} == dict(zip(asked.columns, map(str, asked.types), strict=True))
    assert rounded([tuple(r) for r in found.collect()], found.columns) == rounded(asked.fetchall(), asked.columns)


def test_every_query_has_rows_or_none(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        registry.queries()[name](spark, str(DATA)).collect()
