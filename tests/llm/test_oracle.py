import pytest

from gleaner.llm import queries
from gleaner.llm.sql import SQL
from tests.compare import check

QUERIES = queries.queries()
COLUMNS = {"p1_found": ["id_a", "id_b"], "p2_found": ["id"], "p3_found": ["id", "kind", "snap"], "p4_found": ["id"], "p6_found": ["source"], "p7_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count()
