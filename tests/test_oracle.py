"""Every registered query against its check SQL."""

import pytest

from check import compare, connect
from diamondlap.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    why, _ = compare(spark, con, name, sf_dir)
    assert why is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
