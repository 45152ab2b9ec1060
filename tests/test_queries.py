import pytest

from sigmalake import queries as q
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_against_sql(spark, sf, name):
    check(spark, q.QUERY[name], q.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(q.QUERY) - set(q.SQL)))
def test_query_runs(spark, sf, name):
    assert q.QUERY[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and [r.rank for r in rows if r.query_id == 1] == list(range(1, sum(r.query_id == 1 for r in rows) + 1))
    assert set(e.oracle_sql()) <= set(e.queries()) and set(q.QUERY) <= set(e.queries())


def test_best_formula_join_keeps_every_page(spark, sf):
    """Both indexes see the same terms, so each page found by one is found by the other."""
    from sigmalake.plans import search

    i, c = q.corpus(spark, sf), search.clauses(spark, q.QUERIES)
    a = search.best_formulas(i, c).select("query_id", "page_id")
    b = search.search_pages(i, c).select("query_id", "page_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
