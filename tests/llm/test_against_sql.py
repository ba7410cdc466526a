"""Every query with SQL gives the rows of its SQL, on generated tables, on odd rows and on empty tables."""

import pytest

from plumbline.llm.queries import ORACLE_SQL, QUERIES


def canonical(rows: list[dict]) -> list[tuple]:
    value = lambda v: (v is None, round(v, 9) if isinstance(v, float) else str(v))
    return sorted(tuple((k, value(row[k])) for k in sorted(row)) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("tables", ["generated", "odd", "empty"])
def test_query_equals_sql(spark, sql, odd_dir, empty_dir, name, tables):
    folder = {"generated": "/root/testdata/sf0.001", "odd": odd_dir, "empty": empty_dir}[tables]
    frame = QUERIES[name](spark, folder)
    mine, theirs = [r.asDict() for r in frame.collect()], sql(folder, ORACLE_SQL[name])
    assert canonical(mine) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = QUERIES[name](spark, empty_dir).collect()
    assert len(rows) == (1 if name == "op7_chat_format" else 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_do_not_crash(spark, odd_dir, name):
    QUERIES[name](spark, odd_dir).collect()
