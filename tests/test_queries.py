import __spark_entry__ as entry
import pytest
from holdfast.plans import queries as q

from oracle import SF, assert_equal


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_oracle(spark, name):
    assert_equal(q.QUERIES[name](spark, SF), q.ORACLES[name])


def test_every_query_is_registered():
    assert set(q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "size", "canonical_id", "is_canonical"] and df.count() == 200
