"""Registered queries against DuckDB on the small test tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same_rows  # noqa: E402

from waymark.llm import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLE_SQL:
        same_rows(df, registry.ORACLE_SQL[name], FOLDER)
    else:
        assert df.count() > 0
