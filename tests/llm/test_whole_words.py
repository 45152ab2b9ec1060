"""op3's contexts are whole words: a plain sampler, sums of probabilities, words that end alike."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sigmalake.llm import scoring
from sigmalake.llm.common import fold_of
from sigmalake.llm.packed import rows_of


def learned(n, start=0):
    """Ids that the model learns from."""
    return [i for i in range(start, start + 3 * n) if zlib.crc32(str(i).encode()) % 5 != 1][:n]


def held(n, start=100_000):
    return [i for i in range(start, start + 20 * n) if zlib.crc32(str(i).encode()) % 5 == 1][:n]


def test_words_that_end_alike_are_contexts_of_their_own(spark):
    rows = [(i, f"{a} {b} tail") for i, (a, b) in zip(learned(200), [("northing", "red"), ("something", "blue")] * 100)]
    probes = [f"{a} {b} tail" for a in ("northing", "something", "nothing") for b in ("red", "blue")]
    ids = held(len(probes))
    docs = spark.createDataFrame(rows + list(zip(ids, probes)), "doc_id long, text string")
    assert docs.where(fold_of(docs.doc_id) == 1).count() == len(probes)
    got = {r.doc_id: r.score for r in scoring.score(docs).collect()}
    s = dict(zip(probes, (got[i] for i in ids)))
    assert s["northing red tail"] > s["northing blue tail"] + 1
    assert s["something blue tail"] > s["something red tail"] + 1
    # a word not learned falls back on what all words with its ending say
    assert abs(s["nothing red tail"] - s["nothing blue tail"]) < 0.3
    coarse = {r.doc_id: r.score for r in scoring.score(docs, whole_words=False).collect()}
    s = dict(zip(probes, (coarse[i] for i in ids)))
    assert abs(s["northing red tail"] - s["northing blue tail"]) < 0.3


def corpus(n_docs=150, words=40):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}x" for i in range(words)]
    follow = {w: rng.choice(vocabulary, 4) for w in vocabulary}

    def text():
        out = [rng.choice(vocabulary)]
        for _ in range(int(rng.integers(5, 25))):
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.8 else rng.choice(vocabulary))
        return " ".join(out)

    return [text() for _ in range(n_docs)], [text() for _ in range(40)], vocabulary


class Plain:
    """The same hierarchy, sampled one customer at a time: tables as lists of their sizes."""

    def __init__(self, texts, sweeps, samples):
        self.rng = random.Random(6)
        self.tables = [defaultdict(list) for _ in range(4)]  # level -> (key, word) -> sizes; 0 is the word before
        self.c, self.t = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
        self.d, self.s = [0.5] * 4, [scoring.WORD_STRENGTH, *scoring.STRENGTH[::-1]]
        pairs = [p for text in texts for p in self.pairs(text)]
        self.v = len({w for w, _ in pairs})
        for w, before in pairs:
            self.add(0, w, before)
        self.states = []
        for k in range(sweeps + samples):
            for w, before in pairs:
                self.remove(0, w, before)
                self.add(0, w, before)
            for level in range(4):
                sizes = [sum(x) for x in self.tables[level].values() if x]
                self.d[level] = scoring._rate(sizes.count(1), sizes.count(2))
            if k >= sweeps:
                self.states.append(([{k: (sum(x), len(x)) for k, x in t.items()} for t in self.tables], [c.copy() for c in self.c], [t.copy() for t in self.t], list(self.d)))

    @staticmethod
    def pairs(text):
        w = text.split()
        return list(zip([*w, None], ["\n\n", *w]))

    @staticmethod
    def key(level, before):
        return (before, before[-2:], before[-1:], "")[level]

    def p(self, level, w, before, state=None):
        if level == 4:
            return 1 / (self.v + 1)
        counts, c, t, d = state or (None, self.c, self.t, self.d)
        k = self.key(level, before)
        if counts is None:
            sizes = self.tables[level][k, w]
            own, at = sum(sizes), len(sizes)
        else:
            own, at = counts[level].get((k, w), (0, 0))
        s = self.s[level]
        return (own - d[level] * at + (s + d[level] * t[level][k]) * self.p(level + 1, w, before, state)) / (s + c[level][k])

    def add(self, level, w, before):
        if level == 4:
            return
        k = self.key(level, before)
        sizes, d = self.tables[level][k, w], self.d[level]
        new = (self.s[level] + d * self.t[level][k]) * self.p(level + 1, w, before)
        x = self.rng.random() * (sum(sizes) - d * len(sizes) + new)
        self.c[level][k] += 1
        for i, n in enumerate(sizes):
            x -= n - d
            if x < 0:
                sizes[i] += 1
                return
        sizes.append(1)
        self.t[level][k] += 1
        self.add(level + 1, w, before)

    def remove(self, level, w, before):
        if level == 4:
            return
        k = self.key(level, before)
        sizes = self.tables[level][k, w]
        x = self.rng.random() * sum(sizes)
        i = next(i for i, total in enumerate(np.cumsum(sizes)) if x < total)
        sizes[i] -= 1
        self.c[level][k] -= 1
        if not sizes[i]:
            del sizes[i]
            self.t[level][k] -= 1
            self.remove(level + 1, w, before)

    def score(self, text):
        return sum(math.log10(sum(self.p(0, w, b, s) for s in self.states) / len(self.states)) for w, b in self.pairs(text))


def test_scores_follow_a_plain_sampler(spark, monkeypatch):
    train, probes, _ = corpus()
    plain = Plain(train, 8, 8)
    rows = list(zip(learned(len(train)), train)) + list(zip(held(len(probes)), probes))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: plain.score(t) for i, t in rows}
    for size in (scoring.BUCKET_BYTES, 5_000):
        monkeypatch.setattr(scoring, "BUCKET_BYTES", size)
        got = {r.doc_id: (r.score, r.n_tokens) for r in scoring.score(docs).collect()}
        a = np.array([got[i][0] / got[i][1] for i in want])
        b = np.array([want[i] / got[i][1] for i in want])
        print(np.abs(a - b).mean(), np.abs(a - b).max(), np.corrcoef(a, b)[0, 1], a.mean(), b.mean())
        assert np.abs(a - b).max() < 0.05 and np.corrcoef(a, b)[0, 1] > 0.99
    coarse = {r.doc_id: r.score / r.n_tokens for r in scoring.score(docs, whole_words=False).collect()}
    assert np.mean([coarse[i] for i in want]) < a.mean() - 0.1


@pytest.mark.parametrize("known, buckets", [(0, 1), (7, 3), (65_535, 3)])
def test_probabilities_after_whole_words_sum_to_one(monkeypatch, known, buckets):
    """Over all known words, the unknown one and the end; contexts from the book or not, in one bucket or several."""

    class Part:
        get = staticmethod(lambda: Part)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(scoring, "TaskContext", Part)
    train, _, vocabulary = corpus(60)
    afters = ("w1x", "w11x", "w5x", "new")
    probe = [f"{a} {b}" for a in afters for b in [*vocabulary, "unseen"]] + list(afters)
    flags = [True] * len(train) + [False] * len(probe)
    batch = pa.RecordBatch.from_arrays([pa.array(train + probe), pa.array(range(len(flags))), pa.array(flags)], names=["text", "doc_id", "train"])
    (names,) = [np.sort(t.column(0).to_numpy().astype(np.uint64)) for t in scoring._contexts([batch])]
    book, homes = names[:known], 2
    rows = pa.Table.from_batches(list(scoring._gather(buckets, book)([batch])))

    def grouped(table, f, *kinds):
        table = table.filter(pa.compute.is_in(table["kind"], pa.array(kinds, pa.int32())))
        return pa.concat_tables([f(table.filter(pa.compute.equal(table["bucket"], k))) for k in sorted(set(table["bucket"].to_pylist()))])

    tagged = lambda t, k: t.append_column("sweep", pa.array([k] * len(t), pa.int32()))
    built = last = grouped(rows, scoring._build(book, homes), scoring.PAIRS)
    history, parts = [], [tagged(built.filter(pa.compute.is_in(built["kind"], pa.array([scoring.STRUCTURE, scoring.INDEX], pa.int32()))), -1)]
    for k in range(scoring.BURN_IN + scoring.SAMPLES + 1):
        total = last.filter(pa.compute.equal(last["kind"], scoring.TOTAL)).to_batches()
        found = pa.Table.from_batches(list(scoring._unpacked_totals(total))).group_by(["level", "key"]).aggregate([("customers", "sum"), ("tables", "sum")])
        history.append(scoring.Totals(*(found[c].to_numpy() for c in ("level", "key", "customers_sum", "tables_sum"))))
        now = [tagged(last.filter(pa.compute.equal(last["kind"], scoring.STATE)), k), tagged(grouped(last, scoring._home, scoring.TABLES), k)]
        if k in (0, *range(scoring.BURN_IN + 1, 99)):
            parts += now if k else now[1:]
        if k < scoring.BURN_IN + scoring.SAMPLES:
            every = range(10)
            last = grouped(pa.concat_tables([parts[0], *now]), scoring._sweep(k, history[-1], homes), *every)
    sums = Counter()
    whole = pa.concat_tables(parts)
    for bucket in set(whole["bucket"].to_pylist()):
        _, b, seats, c3, t3, _ = scoring._opened(whole.filter(pa.compute.equal(whole["bucket"], bucket)), homes)
        for k, tables in seats.items():
            own, state = b.seated(*tables)
            p = b.word_probabilities(own, state, history[k], c3, t3[k])
            for c, x in zip(b.contexts[b.ctx].tolist(), p.tolist()):
                sums[c] += x / scoring.SAMPLES
    _, found, code, before, _ = scoring.tokens(pa.array(list(afters)))
    for name in found[before[1::2]].tolist():
        assert sums[name] == pytest.approx(1, abs=1e-9)
    # the answers are these probabilities: a text's score is the product over its tokens
    answers = grouped(whole, scoring._word_answers(history, homes), *range(10))
    rest = rows.filter(pa.compute.is_in(rows["kind"], pa.array([scoring.PLACES, scoring.DOCS], pa.int32())))
    out = scoring._sums(history[-1].n, history[-1].v)(pa.concat_tables([rest, answers])).to_pylist()
    assert len(out) == len(flags) and all(np.isfinite(r["score"]) for r in out)
    assert len(rows_of(answers)) == buckets
