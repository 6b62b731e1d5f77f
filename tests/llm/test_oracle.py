"""Queries that SQL can express against that SQL, on the smoke-size tables."""

from pathlib import Path

import pytest

from tests.compare import connect, differences
from typeflow.llm import catalog

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(catalog.queries()[name](spark, SF_DIR), connect(SF_DIR), catalog.oracle_sql()[name]) == []
