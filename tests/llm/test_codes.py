import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmalake.llm import codes


def brute(vectors, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds over Python integers: (codes, errors, digest)."""
    width = len(vectors[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, o in zip(cut, of) if o == k]
                if own:
                    books[p][k] = tuple(sum(z) // len(own) for z in zip(*own))
    last = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return ["".join(f"{k:02x}" for _, k in r) for r in last], [sum(d for d, _ in r) for r in last], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("values", ["smooth", "ties", "large"])
def test_codes_against_brute_force(spark, values):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 16))
    if values == "ties":  # few values, so distances are often equal, and equal rows among the first
        v = rng.integers(-2, 3, (400, 16)) / 4.0
        v[3] = v[1]
        v[200:300] = v[7]
    if values == "large":
        v *= 10_000
    rows = [(k, v[k].tolist(), k % 3 if k % 5 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7).withColumn("ints", F.lit("clash"))
    got, books = codes.compress(df)
    got = {r.vec_id: r for r in got.collect()}
    most = codes.limit_of(16)
    code, error, text = brute([[max(-most, min(most, int(np.floor(x * 4096)))) for x in r] for r in v])
    assert [got[k].code for k in range(400)] == code and [got[k].error for k in range(400)] == error
    assert codes.digest(books) == text
    sums = {}
    for k, _, label in rows:
        sums[label] = sums.get(label, 0) + error[k]
    assert all(got[k].label_error == sums[label] for k, _, label in rows)


def test_bounds_spare_scans_and_tell_the_same(spark):
    rng = np.random.default_rng(5)
    parts = np.concatenate([rng.normal(c, 30, (500, 4)) for c in rng.uniform(-4000, 4000, (16, 4))]).astype(np.int64)
    book = parts[::500].copy()
    entry, upper, lower = codes.scan(parts, book)
    spared = 0
    for _ in range(5):
        new = np.array([parts[entry == k].sum(axis=0) // max(1, (entry == k).sum()) if (entry == k).any() else book[k] for k in range(16)])
        moved = np.sqrt(((new - book) ** 2).sum(axis=1)) * (1 + codes.SLACK)
        gaps = codes.distances(new, new).astype(float)
        np.fill_diagonal(gaps, np.inf)
        entry, upper, lower, scanned = codes.reassigned(parts, entry, upper, lower, new, moved, np.sqrt(gaps.min(axis=1)) / 2 * (1 - codes.SLACK))
        exact = codes.distances(parts, new)
        assert (entry == exact.argmin(axis=1)).all()
        second = np.partition(exact, 1, axis=1)[:, 1]
        assert (upper**2 >= exact.min(axis=1)).all() and (lower**2 <= second).all()
        spared, book = spared + len(parts) - scanned, new
    assert spared > 3 * len(parts)


def test_codes_of_odd_rows(spark):
    rows = [
        (5, [0.5] * 8, 1), (5, [0.25] * 8, 1), (None, [0.5] * 8, None), (7, None, 1), (8, [float("nan")] * 8, 1), (9, [None] * 8, 1),
        (10, [float("inf")] * 8, 1), (11, [1e300] * 8, 2), (12, [0.5] * 9, 2), (13, [], 2), (14, [-0.0001] * 8, 3),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, books = codes.compress(df, rounds=2)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got.collect()) == [(False, 5), (False, 5), (False, 11), (False, 12), (False, 13), (False, 14), (True, 0)]
    assert books.shape == (8, 7, 2)  # nine components: pairs, the last ones zeros
    assert all(len(r.code) == 16 for r in got.collect())
    empty, books = codes.compress(df.where("false"))
    assert empty.collect() == [] and books.shape == (8, 0, 1)
    with pytest.raises(ValueError):
        codes.compress(df, entries=300)
