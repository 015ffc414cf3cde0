"""Every named query against its SQL on the small tables."""

import pytest
from compare import same

from episodica.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, small, name):
    sql = catalog.oracle_sql()[name]
    assert same(catalog.queries()[name](spark, small), small, sql) == ""


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plan_pushes_filters_and_columns(spark, small):
    plan = catalog.queries()["filter_group"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(group_id), EqualTo(group_id,default)]" in plan
    assert "embedding" not in plan.split("ReadSchema")[-1]
