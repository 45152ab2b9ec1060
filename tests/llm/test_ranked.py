import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmalake.llm import ranked

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k=10):
    """Every document scored for every item, with Python integers."""
    own = [(i, t) for i, text in docs if (t := terms(text))]
    n, total = len(own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    out = []
    for item, text in items:
        found = []
        for i, t in own:
            tf, m = Counter(t), 25 + 75 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms(text) if tf[x])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block", [8_192, 3])
def test_ranked_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)] + ["Ünder", "été", "Word", "wörD"]
    p = 1 / np.arange(1, 65)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(k, text(rng.integers(1, 80))) for k in range(300)]
    docs += [(1000 + k, "same text twice w3") for k in range(40)]  # ties
    docs += [(5, "w1 w40"), (5, "w1 w40"), (None, "w1, W40; w40"), (2000, None), (2001, ""), (2002, "...!"), (2003, "w50 " * 50_000)]
    items = [(k, text(12)) for k in range(25)] + [(100, "same SAME twice"), (100, "w40"), (101, None), (102, "?"), (103, "nowhere"), (None, "w1 w1 w1 été")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("score", F.lit("clash")).withColumn("query", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    assert rows(ranked.search(d, q)) == sorted(brute(docs, items), key=str)
    monkeypatch.setattr(ranked, "QUERY_BYTES", 300)  # several passes
    assert rows(ranked.search(d, q, k=3)) == sorted(brute(docs, items, 3), key=str)


def test_ranked_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(d.where("false"), q).collect() == [] and ranked.search(d, q.where("false")).collect() == []
    assert ranked.search(d, q.withColumn("text", F.lit(" ."))).collect() == []


def _block(n, rng):
    """A block over a rare and a common term: tf and sizes drawn."""
    tf = rng.integers(1, 9, 2 * n).astype(np.int32)
    docs = [np.array([0, 1], np.int32) if k % 50 == 0 else np.array([1], np.int32) for k in range(n)]
    tfs = [tf[2 * k : 2 * k + len(c)] for k, c in enumerate(docs)]
    sizes = rng.integers(20, 200, n).tolist()
    row = ranked._block(list(range(n)), sizes, docs, tfs).to_pylist()[0]
    weights = np.array([ranked.weight(n, n // 50), ranked.weight(n, n)], np.int64)
    return ranked.Block(*(np.array(row[c]) for c in ("sizes", "codes", "df")), row["postings"], weights, n, sum(sizes)), docs, tfs, sizes, weights


def test_bounds_spare_postings_of_common_terms():
    n = 5_000
    block, docs, tfs, sizes, weights = _block(n, np.random.default_rng(1))
    found, scores, read = block.search(np.array([0, 1]), np.array([2, 1]), 0, 10)
    assert read < n // 5  # of 5,100 postings
    total = sum(sizes)
    full = [sum(int(weights[c]) * (2 - c) * (10**9 * int(t) // (1000 * int(t) + 8 * (25 + 75 * s * n // total))) for c, t in zip(cs.tolist(), ts)) for cs, ts, s in zip(docs, tfs, sizes)]
    best = sorted((-x, k) for k, x in enumerate(full))[:10]
    assert sorted(zip((-scores).tolist(), found.tolist()))[:10] == best
    # with a score that other blocks reach, only what may enter is left
    top = -best[4][0]
    found, scores, _ = block.search(np.array([0, 1]), np.array([2, 1]), top, 10)
    assert sorted(zip((-scores).tolist(), found.tolist()))[:5] == best[:5] and scores.min() >= top
