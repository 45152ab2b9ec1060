"""Caller's hooks, the label store, the scan that ends early, progress, evaluation of many queries."""

import shutil
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sigmalake import queries as q
from sigmalake.config import Settings
from sigmalake.functions import hooks
from sigmalake.functions.terms import terms_of, tree_of
from sigmalake.operators import index as index_tables
from sigmalake.operators.progress import observed, reported
from sigmalake.plans import evaluate, explain, search, topk
from sigmalake.sources import labels as label_table
from sigmalake.sources import wiki

SF = "/root/testdata/sf0.001"


# --- hooks ---


def test_table_function(spark):
    hooks.register(spark, "formula_terms")
    hooks.register(spark, "exact_terms", Settings(generalise=False))
    rows = spark.sql("select id, t.* from values (1, 'a + b'), (2, '{'), (3, null), (4, '') v(id, latex), lateral formula_terms(latex) t order by id, ord").collect()
    assert [tuple(r) for r in rows] == [(1, n, *t) for n, t in enumerate(terms_of("a + b"))]
    assert spark.sql("select * from exact_terms('a + b')").count() == 1


def test_rewrites_follow_the_normalisation(spark):
    own = Settings(rewrites=(hooks.renamed_operators({"+": "plus"}), lambda t: t._replace(name="m")))
    assert str(tree_of("b + a", own)) == "<m><mo o='plus'><mi>a</mi><mi>b</mi></mo></m>"
    assert hash(own) is not None and hooks.renamed_operators({"+": "p"}) == hooks.renamed_operators({"+": "p"})
    failing = Settings(rewrites=(lambda t: (_ for _ in ()).throw(ValueError("no")),))
    known = index_tables.analysed(spark.createDataFrame([("a + b",)], "latex string"), failing).first()
    assert known.is_error and known.folded == []


def test_fold_counts_in_scores_and_explanations(spark):
    pages = spark.createDataFrame([(1, "T1"), (2, "T2")], "page_id long, title string")
    formulas = spark.createDataFrame([(1, 1, "x ^ y"), (2, 1, r"\frac{x ^ y}{2}"), (3, 2, "x ^ y")], "formula_id long, page_id long, latex string")
    index = index_tables.build(pages, formulas)
    own = Settings(fold=hooks.mean_proximity)
    i, c = search.prepared(index, [(0, "x ^ y")], own)
    near = {r.doc_id: r.proximity for r in search.matches(i, "page", c, own).select("doc_id", "proximity").distinct().collect()}
    assert near == {1: 0.75, 2: 1.0}  # levels 2 and 3 of a page, asked at 2
    best = {r.doc_id: r.proximity for r in search.matches(i, "page", c).select("doc_id", "proximity").distinct().collect()}
    assert best == {1: 1.0, 2: 1.0}
    whole = search.search(i, c, own).orderBy("page_id").collect()
    parts = explain.explain_scores(i, "page", c, settings=own).groupBy("doc_id").agg(F.sum("contribution").alias("s")).orderBy("doc_id").collect()
    assert [r.page_score for r in whole] == [pytest.approx(r.s) for r in parts]
    assert topk.top_k(i, c, 1, own).orderBy("page_id").collect() == whole


# --- labels ---


def rows(spark, *own):
    return spark.createDataFrame(list(own), label_table.SCHEMA)


def test_store_commits_whole_puts_in_order(spark, tmp_path):
    own = label_table.Store(spark, str(tmp_path / "l"))
    assert own.read().count() == 0
    own.put(rows(spark, ("q", "u", 3), ("q", "v", 1), ("r", "u", 2), ("r", "u", 4)))
    seen, before = own.read(), own.log.latest()[1]
    own.put(rows(spark, ("q", "v", 0), ("q", "u", 1)))
    assert sorted(map(tuple, own.read().collect())) == [("q", "u", 1), ("r", "u", 4)]
    assert seen.count() == 3 and own.read(before).count() == 3  # a reader keeps its commits
    own.put(rows(spark))
    own.compact()
    assert len(own.log.latest()[1]["parts"]) == 1 and sorted(map(tuple, own.read().collect())) == [("q", "u", 1), ("r", "u", 4)]
    own.put(rows(spark, ("q", "v", 5)))
    own.vacuum()
    assert own.read().count() == 3 and len(list((tmp_path / "l").glob("part=*"))) == 2


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(label_table, "COMPACT", 5)  # compactions run among them
    own = label_table.Store(spark, str(tmp_path / "l"))
    own.put(rows(spark, ("n", "u", 1)))
    failed = []

    def writer(k):
        try:
            mine = label_table.Store(spark, own.path)
            for j in range(4):
                mine.put(rows(spark, (f"q{k}", f"u{j}", j + 1), (f"q{k}", f"v{j}", j + 1)))
                mine.transact(lambda now: now.where("query = 'n'").withColumn("relevance", F.col("relevance") + 1))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = {(r.query, r.url): r.relevance for r in own.read().collect()}
    assert got == {("n", "u"): 9} | {(f"q{k}", f"{x}{j}"): j + 1 for k in range(2) for j in range(4) for x in "uv"}


# --- scan, progress ---


def dump(spark, path, pages, files):
    """A dump's numbered files, each with an equal share of the pages in the order of their ids."""
    own = spark.createDataFrame([(i, f"T{i}", "<math>a</math>" * n) for i, n in pages], "page_id long, title string, text string")
    Path(path).mkdir()
    each = len(pages) // files
    for k in range(files):
        part = q._dump(own.where((F.col("page_id") > k * each) & (F.col("page_id") <= (k + 1) * each))).coalesce(1)
        part.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(f"{path}-{k}")
        shutil.copy(next(Path(f"{path}-{k}").glob("part-*")), f"{path}/pages{k + 1}.xml")


def test_scan_ends_at_the_limit(spark, tmp_path):
    path = str(tmp_path / "d")
    dump(spark, path, [(i, i % 4) for i in range(1, 49)], 12)
    names = [f.rsplit("/", 1)[-1] for f, _ in wiki.dump_files(spark, path)]
    assert names == [f"pages{k}.xml" for k in range(1, 13)]  # 10 after 9
    whole = wiki.with_formulas(wiki.read_dump(spark, path)).withColumn("n_formulas", F.size("mathes"))
    for limit in (1, 20, 30, 10_000):
        kept, read = wiki.scan_until(spark, path, limit, wave_bytes=1)
        want = wiki.capped(whole.select("page_id", "title", "mathes", "n_formulas"), limit)
        assert sorted(kept.collect()) == sorted(want.collect())
        assert (len(read) == 12) == (limit > 72)
    kept, read = wiki.scan_until(spark, path, 20, wave_bytes=1)
    assert not any("pages12.xml" in f for f in read) and len(read) <= 7
    assert wiki.scan_until(spark, path, 0)[0].count() == 0


def test_progress_is_told_without_a_job(spark, tmp_path):
    said = []
    df, seen = observed(spark.range(1000), n=F.count("*"), top=F.max("id"))
    with reported(spark, "write", said.append, every=0.05):
        slow = df.repartition(20).rdd.mapPartitions(lambda rows: (time.sleep(0.1), *rows)[1:]).count
        df.write.parquet(str(tmp_path / "x"))
        slow()
    assert seen.get == {"n": 1000, "top": 999}
    assert said and all(s.startswith("write: ") and " of " in s for s in said)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_index_counts_are_those_of_the_writing_pass(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, "a + b"), (2, 1, "{"), (3, 1, None)], "formula_id long, page_id long, latex string")
    counted = index_tables.write(index_tables.build(spark.createDataFrame([(1, "T")], "page_id long, title string"), f), str(tmp_path / "i"))
    assert counted == {"formulas": 3, "errors": 1, "terms": 2}
    assert index_tables.counters(f).first().asDict() == counted


# --- evaluation ---


def test_many_labelled_queries_stay_off_the_driver(spark, monkeypatch):
    index = q.corpus(spark, SF)
    letters = "abcdefg"
    many = [(f"{a} {o} {b} + {n}", "-", 1) for n in range(10, 40) for a in letters for b in letters for o in "+*"]
    few = [("a + b", "http://en.wikipedia.org/wiki/Customer%23000000001", 3), ("{", "-", 2), ("a", "-", 1)]
    labels = rows(spark, *many, *few)
    want = {r.query: r for r in evaluate.evaluate(index, rows(spark, *few), 10).collect()}

    def refused(*_, **__):
        raise AssertionError("a query came to the driver")

    monkeypatch.setattr("sigmalake.functions.terms.query_clauses", refused)
    monkeypatch.setattr("sigmalake.plans.search.query_clauses", refused)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", refused)
    got = {r.query: r for r in evaluate.evaluate(index, labels, 10).collect()}
    assert len(got) == len(many) + 3 and all(got[k] == want[k] for k in want)
