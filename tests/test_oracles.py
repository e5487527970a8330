"""Every registered query of the core against its SQL."""

from __future__ import annotations

import pytest

from sparkloom import plans
from tests.oracle import DATA, connected, same


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, name):
    same(plans.QUERIES[name](spark, DATA).toPandas(), connected().sql(plans.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
