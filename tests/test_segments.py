import threading

import pytest
from pyspark.sql import functions as F

from sigmalake import queries as q
from sigmalake.operators import index as index_tables
from sigmalake.operators.commits import Conflict, Log
from sigmalake.operators.segments import Segments, with_ids
from sigmalake.plans import search
from sigmalake.streaming import ingest

SF = "/root/testdata/sf0.001"


def state(index):
    """Everything a search reads of an index, as sets of rows."""
    out = {}
    for kind in index_tables.KINDS:
        out[kind, "postings"] = {(r.term, r.doc_id, r.page_id, tuple(r.levels), r.norm) for r in index.postings[kind].collect()}
        out[kind, "docs"] = {tuple(r) for r in index.docs[kind].select("doc_id", "len", "norm").collect()}
        out[kind, "blocks"] = {tuple(r) for r in index.blocks[kind].select("term", "norm", "n").collect()}
        out[kind, "size"] = index.sizes[kind].first().n_docs
    out["pages"] = {tuple(r) for r in index.pages.select("page_id", "title").collect()}
    out["formulas"] = {tuple(r) for r in index.formulas.select("formula_id", "page_id", "latex").collect()}
    return out


def rows(spark, pages):
    """Pages as {id: [formulas]}."""
    p = spark.createDataFrame([(i, f"T{i}") for i in pages], "page_id long, title string")
    f = spark.createDataFrame([((i << 20) + n, i, x) for i, own in pages.items() for n, x in enumerate(own)], "formula_id long, page_id long, latex string")
    return p, f


def test_commits_are_exclusive_and_in_order(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.latest() == (0, {})
    log.commit(0, {"n": ["a"]})
    with pytest.raises(Conflict):
        log.commit(0, {"n": ["b"]})
    assert log.latest() == (1, {"n": ["a"]})

    def writer(k):
        for j in range(5):
            Log(spark, str(tmp_path / "log")).update(lambda m: m | {"n": [*m["n"], f"{k}-{j}"]})

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    version, m = log.latest()
    assert version == 21 and sorted(m["n"]) == sorted(["a", *(f"{k}-{j}" for k in range(4) for j in range(5))])
    assert log.update(lambda m: None) == m and log.latest()[0] == 21
    assert all(not f.name.startswith(".") or f.name.endswith(".crc") for f in (tmp_path / "log").iterdir())


def test_segments_are_as_an_index_built_at_once(spark, tmp_path):
    own = Segments(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="no segments"):
        own.open()
    own.append(*rows(spark, {1: ["a + b", "x ^ y"], 2: ["{"], 3: []}))
    held = own.open()
    own.append(*rows(spark, {2: ["b + a"], 4: [r"\frac{a}{b}", "a + b"]}))  # replaces 2
    own.append(*rows(spark, {1: ["c * d"], 5: ["c * d + c"]}))  # replaces 1
    own.append(*rows(spark, {1: []}))  # and again, without formulas
    want = state(index_tables.build(*rows(spark, {1: [], 2: ["b + a"], 3: [], 4: [r"\frac{a}{b}", "a + b"], 5: ["c * d + c"]})))
    assert state(own.open()) == want
    assert len(held.pages.collect()) == 3  # a reader keeps its state
    assert own.merge() and not own.merge()
    assert state(own.open()) == want
    version, m = own.log.latest()
    assert len(m["segments"]) == 1 and m["fixes"] == [] and m["dead"] == 0
    gone = own.vacuum()
    assert len([g for g in gone if g.startswith("segment=")]) == 4 and state(own.open()) == want
    own.append(*rows(spark, {6: ["a + b"]}))
    assert own.open().pages.count() == 6


def test_concurrent_writers_and_a_merge_lose_nothing(spark, tmp_path):
    own = Segments(spark, str(tmp_path / "s"))
    own.append(*rows(spark, {k: ["a + b"] for k in range(1, 4)}))
    own.append(*rows(spark, {k: ["a + b"] for k in range(4, 7)}))
    failed = []

    def go(f):
        try:
            f()
        except Exception as e:
            failed.append(e)

    jobs = [lambda k=k: Segments(spark, own.path).append(*rows(spark, {k: ["c + d"], 100 + k: ["a ^ b"]})) for k in (1, 2, 5)]
    threads = [threading.Thread(target=go, args=(f,)) for f in [*jobs, Segments(spark, own.path).merge]]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    pages = {k: ["a + b"] for k in (3, 4, 6)} | {k: ["c + d"] for k in (1, 2, 5)} | {100 + k: ["a ^ b"] for k in (1, 2, 5)}
    assert state(own.open()) == state(index_tables.build(*rows(spark, pages)))


def test_many_dead_pages_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    from sigmalake.operators import segments

    own = Segments(spark, str(tmp_path / "s"))
    monkeypatch.setattr(segments, "BROADCAST_ROWS", 0)
    own.append(*rows(spark, {1: ["a + b"], 2: ["a + b"]}))
    own.append(*rows(spark, {1: ["c + d"]}))
    assert state(own.open()) == state(index_tables.build(*rows(spark, {1: ["c + d"], 2: ["a + b"]})))


def test_search_of_segments_prunes_by_term(spark, tmp_path):
    own = Segments(spark, str(tmp_path / "s"))
    p, f = q.pages(spark, SF), q.formulas(spark, SF)
    for k in range(2):
        own.append(p.where(f"pmod(page_id, 2) = {k}"), f.where(f"pmod(page_id, 2) = {k}"))
    i, c = search.prepared(own.open(), q.QUERIES[:1])
    plan = search.search(i, c)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert len(scans) == 2 and all("In(term" in x for x in scans) and plan.count("Exchange") == 1


def test_streamed_pages_are_added_once(spark, tmp_path):
    text = {1: "<math>a + b</math>", 2: "<math>{</math> <math>b + a</math>", 3: "none"}
    pages = spark.createDataFrame([(i, f"T{i}", t) for i, t in text.items()], "page_id long, title string, text string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(pages.schema).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(stream, out, str(tmp_path / "state")).awaitTermination()
    own = Segments(spark, out)
    want = state(index_tables.build(pages.select("page_id", "title"), with_ids(pages)))
    assert state(own.open()) == want
    # a batch that comes again after a lost checkpoint is known
    ingest.ingest(stream, out, str(tmp_path / "state2")).awaitTermination()
    assert state(own.open()) == want and len(own.log.latest()[1]["segments"]) == 1
    # a page that comes again is replaced
    spark.createDataFrame([(3, "T3", "<math>x^y</math>"), (3, "T3", None)], pages.schema).write.mode("append").parquet(source)
    ingest.ingest(stream, out, str(tmp_path / "state"), most=2).awaitTermination()
    m = own.log.latest()[1]
    assert len(m["segments"]) == 1 and m["batches"] == {"pages": 1}
    assert own.open().known.where("page_id = 3").select(F.size("folded")).first()[0] == 2
