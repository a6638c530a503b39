"""Every registered query against its SQL counterpart on the smallest fixture."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from shelfspark.plans import registry

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_queries_and_sql_belong_together():
    """The named ones have tests of their own."""
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"enrichment"}
