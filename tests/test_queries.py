"""Every query with SQL gives DuckDB's rows; the others run and give rows."""

import pytest
from compare import rows_of, rows_of_sql

from assocframe.plans import registry
from assocframe.runtime import ship

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    ship(spark)
    found = rows_of(QUERIES[name](spark, small))
    if name in SQL:
        assert found == rows_of_sql(duck, SQL[name])
    else:
        assert found[1] is not None


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_are_pruned_and_pushed(spark, small):
    """A grouped profile reads only its columns; a filter reaches the scan."""
    from pyspark.sql import functions as F

    from assocframe.operators import profile as p
    from assocframe.plans.views import view

    plan = p.profile(view(spark, small, "variants"), p.pvalues())._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and plan.count("Exchange hashpartitioning") == 1
    plan = spark.read.parquet(f"{small}/orders.parquet").where(F.col("o_orderkey") < 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,5)]" in plan
