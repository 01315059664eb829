"""Every core query that SQL can express gives the rows of its SQL."""

import pytest

from ledgerloom.plans import registry
from tests import oracle
from tests.conftest import SMALL

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, duck, name):
    frame = registry.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in frame.collect()]
    answer = duck.execute(SQL[name])
    assert not oracle.difference(frame.columns, rows, [x[0] for x in answer.description], answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0
