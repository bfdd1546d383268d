"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from compare import compare, connect
from cubemerge.plans.registry import QUERIES as RUN
from cubemerge.plans.registry import SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip(f"no tables at {FOLDER}")
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(RUN) == set(SQL)


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, con, name):
    assert compare(RUN[name](spark, FOLDER), con, SQL[name]) == []
