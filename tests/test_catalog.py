import pytest

from emberlog.plans import catalog

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, duck, name):
    same(catalog.queries()[name](spark, SF), duck, catalog.oracles()[name])


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracles().keys()


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
