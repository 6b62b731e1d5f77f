"""Every registered query against its SQL on the smoke-size tables."""

from pathlib import Path

import pytest

import __spark_entry__ as registered
from tests.compare import connect, differences
from typeflow.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())


def test_queries_are_registered():
    assert set(catalog.queries()) <= set(registered.queries())
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    assert differences(registered.queries()[name](spark, SF_DIR), con, registered.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["q01_typing_speed", "q02_session_times", "q35_ingest_batches", "q37_inter_key_interval"])
def test_queries_bring_their_session_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert differences(registered.queries()[name](spark, SF_DIR), con, registered.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry(spark):
    assert registered.entry(spark).count() > 0
