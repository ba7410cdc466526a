"""Every query of the library with SQL gives the rows of its SQL."""

from pathlib import Path

import duckdb
import pytest

from plumbline.plans.queries import FLAGSHIP, ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: (v is None, f"{v:.9g}" if isinstance(v, float) else str(v))
    return sorted(columns), sorted(tuple(value(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def base():
    with duckdb.connect() as found:
        for path in Path(FOLDER).glob("*.parquet"):
            found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        yield found


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, base, name):
    frame = QUERIES[name](spark, FOLDER)
    mine = canonical(frame.columns, frame.collect())
    found = base.execute(ORACLE_SQL[name])
    assert mine == canonical([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLE_SQL
