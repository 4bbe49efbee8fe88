"""Every named query against its SQL on the smallest test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
check_oracle = pytest.importorskip("check_oracle")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return check_oracle.connect(FOLDER)


def test_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, db, name):
    good, note = check_oracle.compare(spark, db, FOLDER, name)
    assert good, note


def test_entry(spark):
    assert entry(spark).count() > 0
