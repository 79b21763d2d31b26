"""Every named query gives the rows of its SQL counterpart."""

import pytest

from compare import compare
from reviewspark.catalogue import ORACLE, QUERIES


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, con, tiny):
    assert compare(spark, con, QUERIES[name], ORACLE[name], tiny) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, tiny):
    assert QUERIES[name](spark, tiny).count() > 0
