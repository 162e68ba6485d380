"""Every catalogue query against its SQL, over whole tables."""

import pytest
from helpers import rows_of

from corpusloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    ours = QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_queries_without_sql(spark, sf):
    assert set(QUERIES) - set(ORACLES) == {"embed_documents", "embed_lsa", "topk_ivf"}
    row = QUERIES["embed_documents"](spark, sf).first()
    assert len(row.embedding) == 384
    assert abs(sum(x * x for x in row.embedding) - 1) < 1e-5


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
