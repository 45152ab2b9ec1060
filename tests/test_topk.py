import pytest
from pyspark.sql import functions as F

from sigmalake import queries as q
from sigmalake.config import Settings
from sigmalake.operators import index as index_tables
from sigmalake.plans import search, topk

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("topk") / "index")
    index_tables.write(index_tables.build(q.pages(spark, SF), q.formulas(spark, SF)), path)
    return index_tables.read(spark, path)


def read_rows(df):
    """Runs ``df``; (its rows, rows that its file scans returned)."""
    rows = df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            plan.append(p.plan())
            continue
        if "FileSourceScan" in name:
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        plan += [kids.apply(k) for k in range(kids.size())]
    return rows, total


LATEX = ("a + b", "a ^ b + z", r"\frac{c}{d}", "c * d + c", "q + r", "a", "a b", "a + b + a ^ b + z + \\frac{a}{b}")
WEIGHTS = (Settings(formula_weight=0.1, page_weight=0.9), Settings(formula_weight=1.0, page_weight=0.0))


@pytest.mark.parametrize(("latex", "settings"), [*((x, Settings()) for x in LATEX), *((LATEX[1], w) for w in WEIGHTS)])
def test_top_k_are_those_of_the_whole_search(index, latex, settings):
    i, c = search.prepared(index, [(0, latex)])
    for k in (1, 10, 60) if latex == "c * d + c" else (10,):
        whole = [(r.page_id, r.formula_id, round(r.score, 9)) for r in search.result_page(search.search(i, c, settings), 1, k).orderBy("rank").collect()]
        found = [(r.page_id, r.formula_id, round(r.score, 9)) for r in search.result_page(topk.top_k(i, c, k, settings), 1, k).orderBy("rank").collect()]
        assert found == whole
    assert topk.total_hits(i, c) == search.search(i, c, settings).count()


@pytest.mark.parametrize("latex", ["a ^ b + z", "c * d + c", "a + b"])
def test_top_k_reads_and_scores_less(index, latex):
    i, c = search.prepared(index, [(0, latex)])
    _, whole = read_rows(search.search(i, c))
    pages = topk.candidates(i, c, 10)
    own, few = read_rows(pages)
    matched = topk.Bounds.of(c, "formula")
    assert matched.postings(matched.norms()) > 4 * len(own) and few < whole
    rows, scored = read_rows(topk.top_k(i, c, 10))
    assert len(rows) < search.search(i, c).count() / 4


def test_bounds_hold(index):
    for latex in ("a ^ b + z", "c * d + c", "a + b"):
        i, c = search.prepared(index, [(0, latex)])
        for kind in index_tables.KINDS:
            bounds = topk.Bounds.of(c, kind)
            m = search.matches(i, kind, c).groupBy("doc_id", "norm").agg(F.collect_set("term").alias("terms"))
            s = search.search_documents(i, kind, c).join(m, "doc_id").select("score", "norm", "terms").collect()
            assert s and all(r.score <= bounds.score(r.norm, r.terms) + 1e-12 <= bounds.highest() + 1e-9 for r in s)


def test_large_candidate_sets_are_joined(index, monkeypatch):
    i, c = search.prepared(index, [(0, "c * d + c")])
    whole = search.result_page(search.search(i, c), 1, 10).orderBy("rank").collect()
    for name in ("LISTED_PAGES", "BROADCAST_ROWS"):
        monkeypatch.setattr(topk, name, 0)
        assert search.result_page(topk.top_k(i, c, 10), 1, 10).orderBy("rank").collect() == whole
