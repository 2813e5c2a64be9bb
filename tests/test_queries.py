"""Every named query against its plain SQL."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry
from factloom.queries import ORACLES, QUERIES
from tests.oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, connection):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], connection) == []


def test_entry(spark):
    assert entry(spark).count() > 0
