import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigmalake.llm import mixing, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one two", "b"), (4, "one two", "b"), (None, "x " * 12, "b"),
    (6, "l1 a b\nl1 a b\n\nl1 a b\n", "c"), (7, "a b c d e " * 4, "c"), (8, "a" * 70_000, "d"), (9, "é# $$ ünï\x0bcode\x1cx y", "d"),
    (10, "w%d " * 3 % (1, 2, 3) * 9000, "a"), (11, "it's <|endoftext|> Á don'. x.,y ... A.", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, s, "clash", 5) for i, t, s in ODD], "doc_id long, text string, source string, size string, rank int")
    return df.withColumnRenamed("rank", "piece")


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    hit = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_against_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    both = docs.union(odd.select("doc_id", "text"))
    got = quality.ledger(both).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r.doc_id, *brute_measures(r.text)) for r in both.collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_quality_ablation_and_empty(spark, sf):
    book = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    rows = {r.rule: r for r in quality.ablation(book, "v2").collect()}
    bits = [r.fail_bits for r in book.collect()]
    for r in quality.RULES:
        others = quality.mask_of(quality.POLICIES["v2"]) ^ (1 << r.bit)
        got = rows[r.name]
        assert got.n_failed == sum(b >> r.bit & 1 for b in bits)
        assert got.n_only == sum(b == 1 << r.bit for b in bits)
        assert got.n_kept_without == sum(not b & others for b in bits)
    assert quality.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing_reaches_targets(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    m = mixing.mix(docs).toPandas()
    assert len(m) == docs.count()
    assert m["target"].groupby(m["source"]).first().sum() == pytest.approx(1.5 * m["size"].sum())
    assert (m["taken"] <= 2 * m["size"]).all()
    for _, g in m.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max() / 2 + 1
        assert g["source_size"].iloc[0] == g["size"].sum()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(map(tuple, m[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ODD) and got["target"].notna().all()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_repeated_rows_and_null_ids(spark):
    rows = [(7, "a b c", "s")] * 900 + [(7, "d e", "s")] * 20 + [(None, "x y", "s")] * 300 + [(None, f"n{k} z", "s") for k in range(200)] + [(k + 10, "p q r s", "s") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_copies", F.lit(1)).withColumn("copies", F.lit("x"))
    m = mixing.mix(docs, share=0.43).toPandas()
    assert len(m) == len(rows) and set(m.copies) == {0, 1}
    assert abs(m.taken.sum() - m.target[0]) <= 2
    again = mixing.mix(docs.repartition(7), share=0.43).toPandas()
    count = lambda d: Counter(zip(d.doc_id.fillna(-1), d["size"], d.copies))
    assert count(m) == count(again)
    taken = mixing.resample(docs, share=0.43)
    assert taken.columns == docs.columns
    words = sum(len(r.text.split()) for r in taken.collect())
    assert words == m.taken.sum()
    # classes in which a target ends, taken row by row
    for share in (0.1, 0.83):
        m = mixing.mix(docs, share=share).toPandas()
        assert abs(m.taken.sum() - m.target[0]) <= 2


def test_mixing_preference_makes_unequal_odds(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), (1 + F.col("id") % 2 * 2).cast("double").alias("like"))
    m = mixing.mix(docs, preference="like", share=0.4).toPandas()
    low, high = m[m.doc_id % 2 == 0].copies.sum(), m[m.doc_id % 2 == 1].copies.sum()
    assert 2.4 < high / low < 3.6
    assert abs(m.taken.sum() - m.target[0]) <= 3


def test_packing_round_trip(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text"))
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack(docs, with_ids=True).toPandas()
    want = Counter((r.doc_id, zlib.crc32(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for r in docs.collect())
    have = Counter()
    for d, g in got.groupby("doc_id", dropna=False):
        whole = [b"".join(g[g.piece >= 0].sort_values("piece").ids)] if g.piece.is_unique else list(g.ids)
        have.update((None if d != d else d, zlib.crc32(x)) for x in whole)
    assert have == want
    assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(got.ids, got.ids_crc32, got.length))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(g.length.cumsum().shift(fill_value=0)) and g.length.sum() <= 4096
    least = -(-int(got.length.sum()) // 4096)
    assert got.sequence_id.nunique() <= least + 3
    assert packing.pack(docs.limit(0)).count() == 0


def test_sum_of_squares_takes_the_least_change():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 17, 300)
    bins, offsets, fill = packing.sum_of_squares(lengths, 16)
    left: list[int] = []
    for s, b, o in zip(lengths, bins, offsets):
        n = Counter(g for g in left if g)

        def after(g):
            m = Counter(n)
            if g != 16:
                m[g] -= 1
            if g - s:
                m[g - s] += 1
            return sum(v * v for v in m.values())

        fits = [g for g in n if g >= s] + [16]
        assert after(16 - o) == min(map(after, fits))
        if b == len(left):
            left.append(16)
        assert left[b] == 16 - o
        left[b] -= s
    assert max(fill) <= 16


def test_known_words_are_bounded_and_right(monkeypatch):
    import duckdb
    import pyarrow as pa

    monkeypatch.setattr(packing, "REMEMBERED", 300)
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]
    ids = packing._Ids(public_tokenizers.path(packing.VOCABULARY))
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for k in range(0, len(texts), 5):
        some = texts[k : k + 5]
        assert list(ids.texts(pa.array(some))) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(some, add_special_tokens=False)]
    assert ids.before and len(ids.known) < 20_000


def test_equal_rows_are_packed_in_bounded_shards(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.col("id").alias("place"))
    got = packing.pack(docs, shard=1_000)
    sizes = [r["count"] for r in got.groupBy(F.expr("sequence_id >> 32").alias("shard")).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 1_500
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end or n > 4096").count() == 0
