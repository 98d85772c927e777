"""Every registered query with an oracle must equal it at sf0.01."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SF01
from tests.oracle_harness import compare

ORACLES = oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, duck):
    df = queries()[name](spark, SF01)
    ok, msg = compare(df, duck, ORACLES[name])
    assert ok, f"{name}: {msg}"


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["term", "n", "pct"]
    assert len(df.collect()) > 0


def test_every_other_query_builds(spark):
    from ledgerlens.plans import catalog
    from tests.conftest import SF001
    for name in sorted(set(catalog.queries()) - set(ORACLES)):
        df = queries()[name](spark, SF001)
        assert df.columns, name
