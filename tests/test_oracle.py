import pytest
from conftest import same_rows

from barline import catalogue

NAMES = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    assert len(same_rows(spark, duck, catalogue.queries()[name], catalogue.oracle_sql()[name]))


def test_every_query_has_sql():
    assert set(NAMES) == set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
