import json

import pytest
from pyspark.sql import functions as F

from sigmalake import api
from sigmalake import queries as q
from sigmalake.operators import index as index_tables
from sigmalake.plans import evaluate, explain, search
from sigmalake.sources import labels as label_table
from sigmalake.sources import wiki

DUMP = """<mediawiki><siteinfo><sitename>W</sitename></siteinfo>
<page><title>T1</title><ns>0</ns><id>7</id><revision><id>1</id><text xml:space="preserve" bytes="9">x &lt;math&gt;a
+ b&lt;/math&gt; y &lt;math&gt;a + b&lt;/math&gt; &lt;math display="block"&gt;q&lt;/math&gt; &lt;Math&gt;z&lt;/Math&gt;</text></revision></page>
<page><title>2001</title><ns>0</ns><id>9</id><revision><id>2</id><text bytes="1">none</text></revision></page>
<page><title>Empty one</title><ns>0</ns><id>11</id><revision><id>3</id><text bytes="0" /></revision></page>
</mediawiki>"""


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    index_tables.write(q.corpus(spark, "/root/testdata/sf0.001"), path)
    return index_tables.read(spark, path)


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    pages = wiki.with_formulas(wiki.read_dump(spark, str(tmp_path / "d.xml")))
    rows = {r.page_id: r for r in pages.collect()}
    assert [rows[i].title for i in (7, 9, 11)] == ["T1", "2001", "Empty one"]
    assert rows[7].mathes == ["a\n+ b", "a + b"] and rows[9].mathes == [] and rows[11].mathes == []
    f = wiki.formulas(pages).orderBy("formula_id").collect()
    assert [(r.formula_id, r.page_id, r.pos, r.doc_title) for r in f] == [(1, 7, 0, "T1"), (2, 7, 1, "T1")]


def test_markup_and_comments_in_a_text_lose_nothing(spark, tmp_path):
    text = "a &lt;math&gt;x + y&lt;/math&gt; <b>b</b> <!-- c --> &lt;math&gt;x &amp;lt; y&lt;/math&gt;<br/> d &lt;math&gt;z^2&lt;/math&gt;"
    (tmp_path / "d.xml").write_text(f'<mediawiki><page><title>T</title><id>5</id><revision><text bytes="3">{text}</text></revision></page></mediawiki>')
    pages = wiki.with_formulas(wiki.read_dump(spark, str(tmp_path / "d.xml"))).collect()
    assert [(r.page_id, r.mathes) for r in pages] == [(5, ["x + y", "x &lt; y", "z^2"])]


def test_columns_of_any_name_stay(spark):
    pages = spark.createDataFrame([(2, 1, "a", "b", "c"), (1, 3, "d", "e", "f")], "page_id long, n_formulas int, _row string, _part string, _before string")
    assert sorted(map(tuple, wiki.capped(pages, 100).select(pages.columns).collect())) == sorted(map(tuple, pages.collect()))
    assert sorted((r.n, r._row) for r in wiki.numbered(pages, ["page_id"], "n").collect()) == [(1, "d"), (2, "a")]


def test_cap_and_ids(spark):
    pages = spark.range(1, 5001).select(F.col("id").alias("page_id"), (F.col("id") % 3).alias("n_formulas"))
    kept = [r.page_id for r in wiki.capped(pages, 1000).orderBy("page_id").collect()]
    total, want = 0, []
    for i in range(1, 5001):
        if total >= 1000:
            break
        want.append(i)
        total += i % 3
    assert kept == want
    ids = wiki.numbered(pages.repartition(7), ["page_id"], "n").collect()
    assert all(r.n == r.page_id for r in ids) and len(ids) == 5000
    assert wiki.capped(pages.limit(0)).count() == 0 and wiki.numbered(pages.limit(0), ["page_id"], "n").count() == 0


def test_index_round_trip(spark, index, tmp_path):
    built = q.corpus(spark, "/root/testdata/sf0.001")
    for kind in index_tables.KINDS:
        for a, b in ((built.postings, index.postings), (built.docs, index.docs), (built.term_stats, index.term_stats)):
            assert a[kind].exceptAll(b[kind].select(a[kind].columns)).count() == 0
    index_tables.write(index, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exists"):
        index_tables.write(index, str(tmp_path / "x"))


def test_search_json(index):
    a = json.loads(api.search_json(index, "a + b", 1, 3))
    assert list(a) == ["status", "query_mathml", "query_detail", "results", "page", "pageSize", "total", "time"]
    assert a["query_mathml"] == "<math><mi>a</mi><mo>+</mo><mi>b</mi></math>" and a["query_detail"].count("<li>") == 2
    first = a["results"][0]
    assert set(first["doc"]) == {"formula_id", "formula", "doc_id", "doc_title", "doc_url"} and "contribution" not in first
    assert "idf" in first["explain"] and a["total"] > 3 and len(a["results"]) == 3
    b = json.loads(api.search_json(index, "a + b", 2, 3))
    assert a["results"][-1]["score"] >= b["results"][0]["score"]
    past = json.loads(api.search_json(index, "a + b", 10_000, 3))
    assert past["results"] == [] and past["total"] == a["total"]
    none = json.loads(api.search_json(index, "a"))
    assert none["results"] == [] and "total" not in none and none["query_detail"] == ""
    for bad in ({"query": ""}, {"query": "{"}, {"query": "a", "page": 0}, {"query": "a", "size": 0}):
        assert json.loads(api.search_json(index, **bad))["status"] == "Fail"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_reads_postings_by_their_terms_only(index):
    """Two scans, pruned by term; no table of documents is read, and matches are shuffled once, for both sides."""
    i, c = search.prepared(index, q.QUERIES[:1])
    plan = plan_of(search.search(i, c))
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert len(scans) == 2 and all("postings_" in x and "In(term" in x for x in scans)
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan and "Join" not in plan


def test_many_clauses_are_not_broadcast_unseen(spark, index, monkeypatch):
    few = sorted(search.search(*search.prepared(index, q.QUERIES)).collect())
    monkeypatch.setattr(search, "FEW_TERMS", 0)
    assert sorted(search.search(*search.prepared(index, q.QUERIES)).collect()) == few
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    i, c = search.prepared(index, q.QUERIES)
    found = search.search(i, c)
    assert not isinstance(c, search.Weighted) and found._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") == 2  # the two sizes, a row each
    again = sorted(found.collect())
    assert [r[:3] for r in again] == [r[:3] for r in few]
    assert all(x.score == pytest.approx(y.score) for x, y in zip(again, few))


def test_formulas_are_analysed_once(spark):
    built = index_tables.build(q.pages(spark, "/root/testdata/sf0.001"), q.formulas(spark, "/root/testdata/sf0.001"))
    for kind in index_tables.KINDS:
        assert plan_of(built.docs[kind]).count("ArrowEvalPython") == 1
    # a formula's terms lie folded in its row: its postings are not shuffled
    assert "Exchange" not in plan_of(q.corpus(spark, "/root/testdata/sf0.001").postings["formula"])
    # page postings need terms and lengths; ``write`` and ``corpus`` make both of one written table
    assert plan_of(q.corpus(spark, "/root/testdata/sf0.001").postings["page"]).count("ArrowEvalPython") == 0


def test_command_line_and_server(spark, tmp_path, capsys):
    import threading
    import urllib.request
    from urllib.parse import quote

    from sigmalake import __main__ as cli
    from sigmalake.config import Settings

    (tmp_path / "d.xml").write_text(DUMP)
    out = str(tmp_path / "out")
    cli.main(["--limit", "0", "index", str(tmp_path / "d.xml"), out])
    said = capsys.readouterr().out
    assert "pages: 3" in said and "formulas: 2" in said and "errors: 0" in said
    cli.main(["search", f"{out}/index", "a + b", "1", "5"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["total"] == 1
    labels = str(tmp_path / "labels")
    cli.main(["put", labels, "a + b", "http://en.wikipedia.org/wiki/T1", "3"])
    cli.main(["perf", f"{out}/index", labels])
    cli.main(["export", labels, str(tmp_path / "l.json")])
    assert json.loads((tmp_path / "l.json").read_text())[0]["labels"][0]["score"] == 3
    capsys.readouterr()
    http = cli.server(index_tables.read(spark, f"{out}/index"), labels, 0, Settings())
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(path, method="GET"):
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}/api/{path}", method=method)
        return json.loads(urllib.request.urlopen(request).read())

    try:
        query, url = quote("a + b", safe=""), quote("http://en.wikipedia.org/wiki/T1", safe="")
        assert call(f"search/{query}/1?size=2")["results"][0]["doc"]["doc_title"] == "T1"
        assert call(f"search/{query}/0")["status"] == "Fail"
        assert call(f"label/{query}/{url}")["label"] == 3
        assert call("dcg/10")["dcg"] == pytest.approx(3)
        assert call(f"label/{query}/{url}/5", "PUT") == {"status": "OK"} and call(f"label/{query}/{url}")["label"] == 5
        assert call(f"label/{query}/{url}", "DELETE") == {"status": "OK"} and call(f"label/{query}/{url}")["label"] == 0
        with pytest.raises(Exception, match="404"):
            call("nothing")
    finally:
        http.shutdown()


def test_terms_reach_the_scan(index):
    i, _ = search.prepared(index, q.QUERIES[:1])
    plan = i.postings["formula"]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1][:200]


def test_contributions_add_up(spark, index):
    c = search.clauses(spark, q.QUERIES)
    for kind in index_tables.KINDS:
        s = search.search_documents(index, kind, c)
        e = explain.explain_scores(index, kind, c).groupBy("query_id", "doc_id").agg(F.sum("contribution").alias("total"))
        both = s.join(e, ["query_id", "doc_id"])
        assert both.count() == s.count() and both.where(F.abs(F.col("score") - F.col("total")) > 1e-9).count() == 0


def test_labels(spark, tmp_path):
    row = lambda *x: spark.createDataFrame(list(x), label_table.SCHEMA)
    labels = label_table.put(label_table.empty(spark), row(("q", "u", 3), ("q", "v", 0), ("r", "u", 5)))
    labels = label_table.put(labels, row(("q", "u", 4), ("r", "u", 0)))
    assert [tuple(r) for r in labels.collect()] == [("q", "u", 4)]
    label_table.write(labels, str(tmp_path / "l"))
    stored = label_table.read(spark, str(tmp_path / "l"))
    assert json.loads(api.label_json(stored, "q", "u"))["label"] == 4 and json.loads(api.label_json(stored, "q", "w"))["label"] == 0
    assert json.loads(label_table.export_json(stored)) == [{"query": "q", "labels": [{"url": "u", "score": 4}]}]
    assert label_table.delete(stored, row(("q", "u", 1))).count() == 0


def test_evaluation(spark, index):
    judged = spark.createDataFrame([("q", 1, 5), ("q", 2, 1), ("q", 3, 2), ("r", 1, 0)], "query string, rank int, relevance int")
    got = {r.query: r for r in evaluate.quality(judged, 10).collect()}
    assert got["q"].dcg == pytest.approx(15 + 0 + 1 / 2) and got["q"].active == 3 and got["q"].precision == pytest.approx(0.2)
    assert got["r"].dcg == 0 and got["r"].active == 0
    top = json.loads(api.search_json(index, "a + b", 1, 2))["results"]
    labels = spark.createDataFrame([("a + b", top[1]["doc"]["doc_url"], 3), ("a", "nowhere", 2)], label_table.SCHEMA)
    d = json.loads(api.dcg_json(index, labels, 2))
    assert [x["query"] for x in d["details"]] == ["a", "a + b"]
    assert d["details"][1]["dcg"] == pytest.approx(3 / 1.584962500721156) and d["details"][1]["precision"] == 0.5 and d["dcg"] == pytest.approx(d["details"][1]["dcg"] / 2)


@pytest.mark.parametrize("files", [("sigmalake", "__spark_entry__.py"), ("sigmalake", "__spark_entry__.py", "corpus_pipeline.py")])
def test_without_the_operators(tmp_path, files):
    """The entry imports and lists the formula queries where the training-data operators are not there."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in files:
        source = os.path.join(root, name)
        if not os.path.exists(source):
            continue
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, str(tmp_path / name))
    shutil.rmtree(tmp_path / "sigmalake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_batch' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
