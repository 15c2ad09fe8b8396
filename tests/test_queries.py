"""Every query with a twin gives the twin's rows; the others give rows."""

from __future__ import annotations

import pytest

from cinderlake.plans import registry
from tests.compare import duck_rows, spark_rows

TWINS = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, data, name):
    assert spark_rows(registry.queries()[name](spark, data)) == duck_rows(duck, TWINS[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(TWINS)))
def test_without_twin(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(TWINS) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["id", "period", "q05", "q50", "q95", "q_length"]
