"""Every registered query against its independent DuckDB statement, on the smallest driver
data: same columns, same types, same multiset of rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402
from supplymetrics.plans.catalog import all_entries  # noqa: E402

from conftest import SMALL  # noqa: E402

NAMES = sorted(all_entries())


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_oracle():
    assert set(NAMES) <= set(E.oracle_sql()) and set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    status, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SMALL)
    assert status == "OK", msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "product_name"
    assert df.count() >= 0
