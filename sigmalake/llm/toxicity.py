"""Toxicity: a logistic classifier with counterfactual regularisation.

Features are the presence of lower-cased letter runs and of their first four
and five bytes, hashed. The loss adds, for labelled texts, the squared change of
the score when identity terms in them are swapped for others of their group, or
a neutral mention of one is put in; so the model learns to ignore who is spoken
of. It is fitted on at most ``SAMPLE`` labelled ids, chosen by a hash, in one
task of an executor; only the weights come to the driver. Texts are scored in
one pass without a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, dropped, fold_of, table, trim, written

#: Most labelled rows that the classifier is fitted on, and features that it keeps.
SAMPLE = 16_000
FEATURES = 20_000
BUCKETS = 1 << 21
#: Weight of the counterfactual penalty, of the squared weights, and of a toxic row.
FAIRNESS = 4.0
RIDGE = 3e-4
POSITIVE = 2.0
#: Chi-square from which a feature is kept: what chance brings among millions of features stays out.
EVIDENCE = 15.0
#: Words whose features a worker remembers.
REMEMBERED = 300_000

#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITY = (
    ("women", "men", "girls", "boys", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "trans"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)

#: Lower-cased ASCII letters and all bytes beyond ASCII make words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself and its first four and five bytes."""
    f = [zlib.crc32(b"w" + word)]
    if len(word) >= 5:
        f += [zlib.crc32(b"4" + word[:4]), zlib.crc32(b"5" + word[:5])]
    return tuple(x % BUCKETS for x in f)


def features(words: set[bytes]) -> set[int]:
    out: set[int] = set()
    for w in words:
        out.update(word_features(w))
    return out


def counterfactual(words: set[bytes], groups=IDENTITY) -> set[bytes]:
    """``words`` with every identity term swapped for the next of its group; without any, with one put in."""
    swap = {t.encode(): g[(i + 1) % len(g)].encode() for g in groups for i, t in enumerate(g)}
    found = words & swap.keys()
    if found:
        return (words - found) | {swap[t] for t in found}
    terms = sorted(swap)
    return words | {terms[sum(map(len, words)) % len(terms)]}


def _examples(groups):
    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(2).cast(pa.binary()):
                words = set((t.as_py() or b"").translate(LETTERS).split())
                x, y = features(words), features(counterfactual(words, groups))
                rows.append((np.array(sorted(x), "<u4").tobytes(), np.array(sorted(y - x), "<u4").tobytes(), np.array(sorted(x - y), "<u4").tobytes()))
            columns = [pa.array(c, pa.binary()) for c in zip(*rows)] if rows else [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, b.column(3)], names=["i", "h", "x", "plus", "minus", "y"])
        trim()

    return run


def _counts(rows: list[bytes]) -> np.ndarray:
    """How many rows hold each feature, some rows at a time."""
    n = np.zeros(BUCKETS, np.int32)
    for at in range(0, len(rows), 500):
        n += np.bincount(np.frombuffer(b"".join(rows[at : at + 500]), "<u4"), minlength=BUCKETS).astype(np.int32)
    return n


def _csr(rows: list[bytes], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each entry and place of its feature in ``keep`` (a sorted array), for the entries in it."""
    where = np.full(BUCKETS, -1, np.int32)
    where[keep] = np.arange(len(keep))
    row, col = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, r in enumerate(rows):
        c = where[np.frombuffer(r, "<u4")]
        c = c[c >= 0]
        row.append(np.full(len(c), i, np.int32))
        col.append(c)
    return np.concatenate(row), np.concatenate(col)


class Model:
    """Weights by hashed feature."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.boring: set[bytes] = set()

    def score(self, text: bytes) -> float:
        z, seen = self.bias, set()
        words = set(text.translate(LETTERS).split())
        words -= self.boring
        for w in words:
            f = self.known.get(w)
            if f is None:
                f = tuple(x for x in word_features(w) if x in self.weights)
                if not f:
                    if len(self.boring) > REMEMBERED:
                        self.boring.clear()
                    self.boring.add(w)
                    continue
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[w] = f
            seen.update(f)
        for x in sorted(seen):
            z += self.weights[x]
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


def fit(examples: list, fairness: float = FAIRNESS, steps: int = 250) -> Model:
    """Logistic regression on rows (x, plus, minus, y) by Adam over all rows at once; the same rows give the same model."""
    y = np.array([r[3] for r in examples], float)
    n, positive = len(y), int(np.sum([r[3] for r in examples]))
    if positive in (0, n):
        return Model({}, float(np.log((positive + 0.5) / (n - positive + 0.5))))
    all_of, toxic = _counts([r[0] for r in examples]), _counts([r[0] for r in examples if r[3]])
    expected = (all_of * (positive / n)).astype(np.float32)
    chi = np.where(all_of >= 3, (toxic - expected) ** 2 / np.maximum(expected * (1 - positive / n), 1e-9), 0)
    keep = np.argsort(-chi, kind="stable")[:FEATURES]
    keep = np.sort(keep[chi[keep] > EVIDENCE])
    row, col = _csr([r[0] for r in examples], keep)
    prow, pcol = _csr([r[1] for r in examples], keep)
    mrow, mcol = _csr([r[2] for r in examples], keep)
    weight = np.where(y > 0, POSITIVE, 1.0) / n
    w, bias = np.zeros(len(keep)), float(np.log(positive / (n - positive)))
    m, v, mb, vb = np.zeros(len(keep)), np.zeros(len(keep)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[col], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        g = (p - y) * weight
        # the score's change when identity terms are swapped, to be zero
        d = np.bincount(prow, w[pcol], minlength=n) - np.bincount(mrow, w[mcol], minlength=n)
        dg = 2 * fairness * d / n
        grad = np.bincount(col, g[row], minlength=len(keep)) + RIDGE * w
        grad += np.bincount(pcol, dg[prow], minlength=len(keep)) - np.bincount(mcol, dg[mrow], minlength=len(keep))
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        step = 0.1 * (1 - t / (steps + 1))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    big = np.abs(w) > 1e-3
    return Model({int(k): float(x) for k, x in zip(keep[big], w[big])}, bias)


def _fitted(fairness: float):
    """All examples, in one task -> (feature, weight) of the model fitted on them; feature -1 is the bias."""

    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)))]
        rows.sort()
        model = fit(rows, fairness)
        features, weights = [-1, *model.weights], [model.bias, *model.weights.values()]
        del rows, model
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.int64()), pa.array(weights, pa.float64())], names=["feature", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, groups=IDENTITY, fairness: float = FAIRNESS) -> Model:
    """The classifier, from labelled ids outside fold 0, at most ``sample`` of them (the least hashes of the id).

    An id counts as toxic if any of its labels is. Of rows that repeat an id the
    text with the least hash is learned from, so the same rows give the same
    model whatever their order and partitioning. Without rows to learn from, or
    with labels of one kind only, all texts get one score.
    """
    arrow_rows(docs.sparkSession)
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    y = y.groupBy(F.col(id_col).cast("long").alias("i")).agg((F.max(label_col) > 0).cast("int").alias("y")).where(fold_of(F.col("i")) != 0)
    y = y.orderBy(F.xxhash64("i"), "i").limit(sample)
    d = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    # the sample has a bound, so its side is broadcast
    own = d.join(F.broadcast(y), "i").select("i", F.xxhash64("t").alias("h"), F.coalesce("t", F.lit("")).alias("t"), "y")
    own = own.mapInArrow(_examples(groups), "i long, h long, x binary, plus binary, minus binary, y int")
    one = own.groupBy("i").agg(F.min(F.struct("h", "x", "plus", "minus", "y")).alias("r")).select("r.x", "r.plus", "r.minus", "r.y")
    examples = written(one, "examples")
    found = examples.coalesce(1).mapInArrow(_fitted(fairness), "feature long, weight double").collect()  # at most FEATURES + 1 rows
    dropped(examples)
    weights = {r.feature: r.weight for r in found}
    bias = weights.pop(-1, 0.0)
    return Model(weights, bias)


def _scores(weights: dict[int, float], bias: float):
    def run(batches):
        model = Model(weights, bias)
        for b in batches:
            s = np.fromiter((model.score(t.as_py() or b"") for t in b.column(1).cast(pa.binary())), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])
        del model
        trim()

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts get the score of a text without words. Repeated rows
    and null ids give a row each; an empty table gives none.
    """
    arrow_rows(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    s = d.mapInArrow(_scores(model.weights, model.bias), "doc_id long, score double")
    return s.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(weights: dict[int, float], bias: float, at: int):
    def run(batches):
        model = Model(weights, bias)
        for b in batches:
            ok = [model.score(t.as_py() or b"") < 0.5 for t in b.column(at).cast(pa.binary())]
            yield b.filter(pa.array(ok, pa.bool_()))
        del model
        trim()

    return run


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under 0.5."""
    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(_clean(model.weights, model.bias, docs.columns.index(text_col)), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
