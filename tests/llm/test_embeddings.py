import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmalake.llm import embeddings


def brute(rows, cosine=0.98):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links, root = set(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                links.add((a, b))
                root[find(b)] = find(a)
    return links, [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("part", [4_000, 5])
def test_embeddings_against_brute_force(spark, sf, monkeypatch, part):
    monkeypatch.setattr(embeddings, "PART", part)
    rng = np.random.default_rng(1)
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    base = rng.standard_normal(64)
    rows += [(2000 + k, (base + rng.standard_normal(64) * 0.08).tolist(), 3) for k in range(60)]
    rows += [(3000 + k, rows[5][1], rows[5][2]) for k in range(4)] + [(3000, rows[5][1], rows[5][2] + 1), (None, rows[5][1], rows[5][2])]
    rows += [(4000, None, 1), (4001, [0.0] * 64, 1), (4002, [float("nan")] * 64, 1), (4003, [None] + [1.0] * 63, 1), (4004, rows[0][1], None), (4005, [], 1), (4006, [1.0], 1), (4007, [2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("clash"))
    links, root = brute(rows)
    got = {(r.vec_id, k): r for k, r in enumerate(embeddings.near_duplicates(df).orderBy("vec_id").collect())}
    assert len(got) == len(rows)
    degree = np.bincount(np.array(sorted(links)).ravel(), minlength=len(rows))
    by_id = {}
    for (i, _), r in got.items():
        by_id.setdefault(i, []).append(r.n_links)
    found = total = 0
    for i in by_id:
        want = sorted(int(degree[k]) for k in range(len(rows)) if rows[k][0] == i)
        assert all(a <= b for a, b in zip(sorted(by_id[i]), want))
        found, total = found + sum(by_id[i]), total + sum(want)
    assert found >= 0.9 * total
    if found == total:
        ids = {}
        for k, r in enumerate(root):
            if rows[k][0] is not None:
                ids[r] = min(ids.get(r, 1 << 60), rows[k][0])
        want = sorted((rows[k][0], ids[r]) for k, r in enumerate(root) if rows[k][0] is not None)
        assert sorted((i, r.component_id) for (i, _), r in got.items() if i is not None) == want
        assert all(r.kept == (i == r.component_id) for (i, _), r in got.items())
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_more_vectors_take_more_projections():
    assert embeddings.plan(100)[0] < embeddings.plan(10_000)[0] < embeddings.plan(10**9)[0]
    k, tables = embeddings.plan(5000)
    assert 1 - (1 - embeddings.collision(0.2) ** k) ** tables >= embeddings.RECALL


def test_sparse_chains_of_a_large_cell_stay_connected():
    rng = np.random.default_rng(1)
    for n in (1400, 2000, 4000):
        angle = rng.permutation(n) * (2 * np.pi / n)
        unit = np.stack([np.cos(angle), np.sin(angle)], axis=1)
        count, root = embeddings._linked(unit, np.ones(n), np.zeros((n, 1), np.int64), 0, np.zeros(n, int), (0, 0), np.cos(3.5 * 2 * np.pi / n))
        assert (count == 6).all() and (root == root[0]).all()
