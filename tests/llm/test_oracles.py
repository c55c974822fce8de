import pytest

from evaquery.llm.queries import ORACLE, QUERIES

from .. import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_its_sql(spark, name):
    assert oracle.mismatch(QUERIES[name](spark, SF), ORACLE[name], oracle.connect(SF)) == ""
