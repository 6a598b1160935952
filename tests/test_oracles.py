"""Every registered query of the core that has SQL, against DuckDB."""

import os

import pytest

from bellwether.plans import documents, evaluation, general, market, streams
from tests.compare import DATA, connect, rows_of_duckdb, rows_of_spark

MODULES = (general, market, evaluation, documents, streams)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, module, name):
    df = module.QUERIES[name](spark, DATA)
    cols, rows = rows_of_spark(df)
    assert len(cols) == len(set(cols))
    if name in module.SQL:
        want_cols, want = rows_of_duckdb(connect(), module.SQL[name])
        assert cols == want_cols
        assert rows == want
