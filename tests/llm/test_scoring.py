import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigmalake.llm import scoring


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_scoring(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(9000, None), (9001, ""), (9002, "  "), (9003, "a B\x0bb\x1c é"), (9003, "zz"), (None, "a b"), (9005, "x " * 50_000)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("train", F.lit(3))
    rows = docs.collect()
    train = Counter()
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
    for r in rows:
        if fold(r.doc_id) != 1:
            train.update([*words_of(r.text), None])
    n, v = sum(train.values()), len(train)
    want = []
    for r in rows:
        w = [*words_of(r.text), None]
        base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((-1 if r.doc_id is None else r.doc_id, fold(r.doc_id) == 1, len(w), sum(train[x] > 0 for x in w), n, round(base, 4)))
    scores = scoring.score(docs).cache()
    got = scores.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:5], round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    for r in scoring.perplexity(scores.where("doc_id < 9000")).collect():
        assert r.perplexity < r.base_perplexity
    # one bucket or many, and other partitions: the same scores
    monkeypatch.setattr(scoring, "BUCKET_BYTES", 100_000)
    again = {(r.doc_id, r.n_tokens): r.score for r in scoring.score(docs.repartition(3)).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score, rel=1e-6) for r in got)
    assert scoring.score(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, in every context."""
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}x" for i in range(40)] + ["ab", "cd", "e"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60), p=np.r_[0.3, np.full(42, 0.7 / 42)])) for _ in range(60)]
    probe = [f"{a} {b}" for a in ("w1x", "ab", "e", "new") for b in [*vocabulary, "unseen"]]
    ids = list(range(len(texts) + len(probe)))
    flags = [True] * len(texts) + [False] * len(probe)

    class Part:
        @staticmethod
        def get():
            return Part

        @staticmethod
        def partitionId():
            return 0

    scoring.TaskContext, kept = Part, scoring.TaskContext
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(texts + probe), pa.array(ids), pa.array(flags)], names=["text", "doc_id", "train"])
        rows = pa.Table.from_batches(list(scoring._gather(1)([batch])))
    finally:
        scoring.TaskContext = kept
    pairs = rows.filter(pa.compute.equal(rows["kind"], scoring.PAIRS))
    merged = scoring._merge(pairs).to_batches()
    history = []
    for _ in range(scoring.BURN_IN + scoring.SAMPLES + 1):
        (t,) = scoring._totals(history)(merged)
        history.append(scoring.Totals(*(t.column(k).to_numpy() for k in range(4))))
    totals = history[-1]
    rest = rows.filter(pa.compute.not_equal(rows["kind"], scoring.PAIRS))
    answers = pa.Table.from_batches(list(scoring._answers(history)(merged)))
    out = scoring._sums(totals.n, totals.v)(pa.concat_tables([rest, answers])).to_pylist()
    by_text = {(texts + probe)[r["doc_id"]]: r["score"] for r in out if r["doc_id"] >= len(texts)}
    model = _pair_probabilities(pairs, history)
    for a in ("w1x", "ab", "e", "new"):
        suffix = a[-2:] if len(a) > 1 else " " + a
        total = sum(model[suffix, b] for b in [*vocabulary, "unseen", None])
        assert total == pytest.approx(1, abs=1e-9)
        for b in vocabulary:  # a text's score is the product over its tokens
            end = b[-2:] if len(b) > 1 else " " + b
            want = math.log10(model["\n\n", a] * model[suffix, b] * model[end, None])
            assert by_text[f"{a} {b}"] == pytest.approx(want, abs=1e-4)


def _pair_probabilities(pairs, history):
    import xxhash

    b = scoring.Bucket(scoring.rows_of(pairs))
    place = {h: i for i, h in enumerate(b.hashes.tolist())}
    p0s, p1s, p2s = [], [], []
    for k, (t2, c1, t1, c0, t0) in enumerate(b.states(history[:-1])):
        if k <= scoring.BURN_IN:
            continue
        (d2, d1, d0), c, tt = history[k].d, history[k].c, history[k].t
        p0s.append((c0 - d0 * t0 + (10.0 + d0 * tt[2][0]) / (history[k].v + 1)) / (10.0 + c[2][0]))
        p1s.append(({(w, k): (x, y) for w, k, x, y in zip(b.mid_word.tolist(), b.k1.tolist(), c1.tolist(), t1.tolist())}, d1, c[1], tt[1]))
        p2s.append(({(w, k): (x, y) for w, k, x, y in zip(b.word.tolist(), b.k2.tolist(), b.c2.tolist(), t2.tolist())}, d2, c[0], tt[0]))

    class Model:
        def __getitem__(self, key):
            suffix, word = key
            h = scoring.END_HASH if word is None else xxhash.xxh64_intdigest(word.encode())
            w, k2 = place[h], suffix.encode()[0] << 8 | suffix.encode()[1]
            k1 = k2 & 255
            out = 0.0
            for p0, (m1, d1, c1, t1), (m2, d2, c2, t2) in zip(p0s, p1s, p2s):
                x, y = m1.get((w, k1), (0, 0))
                p1 = (x - d1 * y + (2 + d1 * t1[k1]) * p0[w]) / (2 + c1[k1])
                x, y = m2.get((w, k2), (0, 0))
                out += (x - d2 * y + (2 + d2 * t2[k2]) * p1) / (2 + c2[k2])
            return out / len(p0s)

    return Model()


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(1)
    c = np.repeat([1, 2, 5, 1000], 4000)
    dish = rng.integers(0, 1 << 63, len(c)).astype(np.uint64)
    t = scoring.seat(c, np.full(len(c), 1.0), np.full(len(c), 0.1), 0.5, dish).reshape(4, -1)
    assert (t[0] == 1).all()
    assert abs((t[1] == 2).mean() - 1.1 / (1 - 0.5 + 1.1)) < 0.03
    one = []
    for _ in range(400):
        n = k = 1
        while n < 1000:
            push = 1 + 0.1 * k
            k += rng.random() < push / (n - 0.5 * k + push)
            n += 1
        one.append(k)
    assert abs(t[3].mean() - np.mean(one)) < 0.5
    assert (t <= c.reshape(4, -1)).all()


@pytest.mark.parametrize("m, p", [(3, 0.2), (20, 0.01), (40, 0.5), (500, 0.3)])
def test_binomial_draws(m, p):
    u = scoring.uniforms(np.random.default_rng(2).integers(0, 1 << 63, 40_000).astype(np.uint64), 7)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.01
    k = scoring.binomial(np.full(len(u), m), np.full(len(u), p), u)
    assert 0 <= k.min() and k.max() <= m
    assert abs(k.mean() - m * p) < 4 * math.sqrt(m * p * (1 - p) / len(u)) + 0.005
    assert k.var() == pytest.approx(m * p * (1 - p), rel=0.05)


def test_a_dish_alone_follows_the_exact_posterior():
    """Tables of one dish in its restaurant, by sweeps, against the probabilities of all table counts."""
    n, strength, discount, parent = 4, 2.0, 0.5, 0.3
    # weight of t tables: number of seatings (generalised Stirling) times the restaurant's terms
    stirling = np.zeros((n + 1, n + 1))
    stirling[0, 0] = 1
    for c in range(n):
        for t in range(c + 2):
            stirling[c + 1, t] = (stirling[c, t - 1] if t else 0) + (c - discount * t) * stirling[c, t]
    weight = np.array([stirling[n, t] * np.prod([strength + discount * j for j in range(1, t)]) * parent**t if t else 0 for t in range(n + 1)])
    weight /= weight.sum()
    dish = np.random.default_rng(3).integers(0, 1 << 63, 60_000).astype(np.uint64)
    c, p = np.full(len(dish), n), np.full(len(dish), parent)
    t = scoring.seat(c, strength * p, discount * p, discount, dish)
    got = np.bincount(t, minlength=n + 1) / len(t)
    # seating one by one is the process's own order; it comes near the posterior, which weighs the dish's draws too
    assert np.abs(got - weight).sum() / 2 < 0.12
