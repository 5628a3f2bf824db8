"""Every query with SQL gives the rows of the SQL; the others run and have a stable schema."""

import pytest

from tests.compare import same_rows
from tests.conftest import SF
from tracelab.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    same_rows(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark, duck):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["aoi", "sheet", "med"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
