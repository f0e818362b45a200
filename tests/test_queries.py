"""Every bibliographic query against its SQL."""

import pytest

from litsieve.plans.registry import QUERIES, SQL


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(row[k] for k in order) for row in data], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    cursor = duck.cursor().execute(SQL[name])
    want = cursor.fetchall()
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want)


#: queries that send rows through Python themselves; those of calls (search_, stream_, works_, snowball_live) did so before the
#: table that their plan reads was written
IN_PYTHON = {"response_dump"}


def test_no_python_in_plans(spark, sf):
    for name, query in QUERIES.items():
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert ("Python" in plan or "Arrow" in plan) == (name in IN_PYTHON), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
