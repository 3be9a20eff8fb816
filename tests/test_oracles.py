"""Every query beside its SQL on the smallest tables."""

import os
import sys

import pytest
from conftest import TESTDATA

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402
from fleetfit.plans.registry import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def tables():
    return check_oracles.connect(TESTDATA)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, tables, name):
    outcome = check_oracles.compare(spark, tables, TESTDATA, name)
    assert outcome.startswith(("ok", "rows-only")), outcome
