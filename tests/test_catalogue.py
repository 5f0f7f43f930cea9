"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest
from compare import differences, oracle

from framestack.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLES:
        wanted = oracle(ORACLES[name], data)
        assert len(wanted)
        assert differences(got, wanted) == ""
    else:
        assert len(got)
