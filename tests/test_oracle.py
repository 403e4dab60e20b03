import pytest

from tests.compare import connect, same
from tidewell import plans

QUERIES, SQL = plans.collected()


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    if name in SQL:
        assert same(df, con, SQL[name]) is None
    else:
        df.write.format("noop").mode("overwrite").save()
