"""Every query that SQL can express equals DuckDB on the same tables, to the last bit."""

import pytest
from oracle_compare import compare, connect

from shelfsense.plans.catalogue import QUERIES
from shelfsense.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ["als_item_topk", "serve_offline"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
