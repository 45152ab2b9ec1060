import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sigmalake.llm import substrings


def brute(rows, window=13):
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    big = 1 << 63
    first = {}
    for i, w in rows:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, w in rows:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (big if i is None else i):
                gone |= set(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def found(spark, docs):
    got = substrings.remove_repeats(docs)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect())


def random_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["é", "ü#"]
    passages = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 25, 60)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((i * 3 % 149 if i % 9 else None, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(7, None), (8, ""), (9, " \n "), (9, "x " * 40), (11, "x " * 40), (12, rows[3][1]), (12, rows[3][1])]


@pytest.mark.parametrize("block, bytes_", [(1_500_000, 24_000_000), (60, 300)])
def test_substrings_against_brute_force(spark, monkeypatch, block, bytes_):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bytes_)
    rows = random_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ranges", F.lit("clash")).repartition(3)
    assert found(spark, docs) == brute(rows)


def test_many_arrow_batches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "arrow_rows", lambda spark: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7))
    rows = random_rows()
    assert found(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def test_substrings_on_documents(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(spark, docs) == want
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", -1)
    assert found(spark, docs) == want
    assert found(spark, docs.limit(0)) == []


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a", "b", "c", "d"), (2, f"x {text} y", "e", "f", "g", "h"), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _ranges string, ranges string, row string")
    got = sorted(map(tuple, substrings.strip_repeats(docs).select(docs.columns).collect()))
    assert got == [rows[0], (2, "x y", "e", "f", "g", "h"), rows[2]]
