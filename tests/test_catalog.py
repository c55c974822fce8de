import pytest

from evaquery import catalog

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        assert oracle.mismatch(df, catalog.ORACLE[name], con) == ""
    else:
        df.collect()
