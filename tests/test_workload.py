import pytest
from oracle import compare, connect

from keyloom import workload

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    compare(spark, con, SF, workload.QUERIES[name], workload.SQL[name])


def test_registered_keys_are_keys(spark):
    star = workload.Star(spark, "/root/testdata/sf0.001")
    for table, key in star.KEYS.items():
        star.schema.register(star.table(table), key)
