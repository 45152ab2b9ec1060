import re

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_simhash import brute_groups
from tests.llm.test_substrings import brute

from sigmalake.llm import mixing, toxicity


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"  # enough labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(7000, None, None, None, None), (7001, "", "en", "src0", 0), (7002, "a b", "en", "src1", 3), (7002, "a b", "en", "src1", 3), (None, "some other words here", "en", "src2", 9)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    columns = docs.columns
    rows = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "substrings", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    a = stage["toxicity"](spark, docs, sf).cache()
    assert a.columns == columns
    key = lambda r: str(tuple(r))
    want = [r for r in rows if model.score((r.text or "").encode()) < 0.5]
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, want), key=key) and len(want) < len(rows)

    b = stage["simhash"](spark, a, sf).cache()
    named = {r.doc_id: r for r in want if r.doc_id is not None}
    ids = sorted(named)
    comp = brute_groups(ids, [named[i].text for i in ids])
    assert b.columns == columns
    assert sorted(r.doc_id for r in b.collect() if r.doc_id is not None) == [i for i in ids if comp[i] == i]
    assert b.where("doc_id is null").count() == 1

    c = stage["substrings"](spark, b, sf).cache()
    assert c.columns == columns
    left = {r.doc_id: r for r in b.collect()}
    for (i, _, gone, _, kept), r in zip(brute([(r.doc_id, r.text) for r in b.collect()]), sorted(c.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)):
        before = left[None if i == -1 else i]
        assert r.text == (kept if gone else before.text) and (r.lang, r.source) == (before.lang, before.source)
        assert r.n_chars == (None if r.text is None else len(r.text))

    d = stage["mixing"](spark, c, sf).cache()
    assert d.columns == columns
    taken = {r.doc_id: r.copies for r in mixing.mix(c).collect()}
    have = {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    assert have == {i: n for i, n in taken.items() if n}

    e = stage["packing"](spark, d, sf).toPandas()
    assert (e.groupby("sequence_id").length.sum() <= 4096).all()
    assert e.groupby("doc_id", dropna=False).size().sum() >= d.count()
    assert set(e.doc_id.dropna()) == {i for i in have if i is not None}


def test_run_on_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
