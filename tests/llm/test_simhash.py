import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from pyspark.sql import functions as F

from sigmalake.llm import simhash
from sigmalake.llm.common import components


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps, threshold=4):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= threshold:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def brute_groups(ids, texts, similarity=0.8):
    """Smallest id of each group linked by the Jaccard similarity of five-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return {i: find(i) for i in ids}


def test_similar_groups_against_brute_force(spark, sf):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words = [f"w{i}" for i in range(3000)]
    rows = [(800, None), (801, ""), (802, "One two"), (803, "one TWO "), (804, "two one"), (None, "one two")]
    for k in range(4):
        base = [rng.choice(words) for _ in range(150 + 60 * k)]
        for j in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((1000 + 100 * k + j, " ".join(w)))
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    named = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    ids = sorted(named)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == brute_groups(ids, [named[i] for i in ids])
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in ids if got[i] == i]
    assert kept.where("doc_id is null").count() == 1 and simhash.keep_one(docs.limit(0)).count() == 0


def pairs_found(spark, pairs):
    """How many of ``pairs`` of texts are groups of their own."""
    rows = [(2 * k + end, t) for k, pair in enumerate(pairs) for end, t in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(c // 2 == i // 2 for i, c in got.items())
    return sum(got[2 * k + 1] == 2 * k for k in range(len(pairs)))


def test_similar_texts_of_one_vocabulary(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    pairs = []
    for _ in range(150):
        w = words + [rng.choice(words) for _ in range(240)]
        rng.shuffle(w)
        x = list(w)
        x[rng.randrange(300)] = rng.choice(words)
        pairs.append((" ".join(w), " ".join(x)))
    assert pairs_found(spark, pairs) == 150
    # a group whose members all share a passage, split into a grid
    passage = " ".join(f"p{i}" for i in range(600))
    shared = [(f"{passage} {a}", f"{passage} {b}") for a, b in pairs[:60]]
    rows = [(2 * k + end, t) for k, pair in enumerate(shared) for end, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(simhash.similar_groups(docs).collect())
    monkeypatch.setattr(simhash, "GROUP_ROWS", 10)
    assert sorted(simhash.similar_groups(docs).collect()) == whole
    assert {r.doc_id: r.component_id for r in whole} == brute_groups([i for i, _ in rows], [t for _, t in rows])


def test_rows_that_repeat_an_id(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "b", 0), (1, long, "a", 0), (1, "something else", "c", 0), (2, long + " x", "d", 0), (2, "other words here", "e", 0), (None, long, "f", 0), (None, long, "f", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same string, component_id int")
    seen = set()
    for d in (docs, docs.repartition(3)):
        kept = simhash.keep_one(d)
        assert kept.columns == docs.columns
        got = sorted((str(r.doc_id), r.text, r.same) for r in kept.collect())
        assert [x[:2] for x in got] == [("1", "something else"), ("1", long), ("2", "other words here"), ("None", long), ("None", long)]
        seen.add(got[1][2])
    assert len(seen) == 1


@pytest.mark.parametrize("words, appended, replaced", [(60, 13, 0), (150, 36, 0), (400, 98, 0), (150, 0, 11), (400, 0, 40)])
def test_passages_appended_or_replaced_near_the_threshold(spark, words, appended, replaced):
    rng = random.Random(words + appended)
    word = lambda: f"v{rng.randrange(1 << 40)}"
    pairs = []
    for _ in range(100):
        w = [word() for _ in range(words)]
        at = rng.randrange(5, words - replaced - 5)
        x = w[:at] + [word() for _ in range(replaced)] + w[at + replaced :] + [word() for _ in range(appended)]
        pairs.append((" ".join(w), " ".join(x)))
    assert brute_groups([0, 1], pairs[0]) == {0: 0, 1: 0}
    assert pairs_found(spark, pairs) == 100


def test_simhash_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "É a b c d"), (906, "a b c d " * 30_000)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("fp", F.lit("clash"))
    rows = docs.collect()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(r.text) for r in rows]
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == {r.doc_id: f for r, f in zip(rows, fps)}
    assert {i: r.component_id for i, r in got.items()} == brute_components([r.doc_id for r in rows], fps)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [0, 1, 2])
def test_cover_meets_every_near_pair(exact):
    rng = random.Random(exact)
    cover = simhash.Cover(exact)
    for _ in range(150):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        homes, others = set(), set()
        for key, _, home in cover(np.array([x], np.uint64)):
            homes |= set(key[home].tolist())
        for key, _, _ in cover(np.array([y], np.uint64)):
            others |= set(key.tolist())
        assert homes & others


def test_split_anchors_and_dense_groups_keep_every_link(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base[:3]:
        for _ in range(400):
            x = b
            for k in rng.sample(range(64), 2):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x, x) for x in signed], "fp long, id long")
    want = brute_components(signed, fps)
    for rows in (100_000, 120):
        monkeypatch.setattr(simhash, "ANCHOR_ROWS", rows)
        got = {r.node: r.component for r in components(simhash.links(df, len(fps))).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, None), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_of_prefixes_are_even(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text]
    none = np.zeros(0, np.uint64)
    first = np.concatenate([simhash.prefix(s, none, none) for _, s in simhash._shingle_sets(pa.array(texts))])
    n = np.bincount(simhash.bucket_of(first, 100).astype(np.int64), minlength=100)
    # a shingle that many texts share is one key; its weight is no matter of the hash
    n_once = np.bincount(simhash.bucket_of(np.unique(first), 100).astype(np.int64), minlength=100)
    assert n_once.max() < 1.1 * n_once.mean() and n.max() < 1.5 * n.mean()


def test_a_task_gives_equal_texts_once():
    text = " ".join(f"w{k}" for k in range(500))
    none = np.zeros(0, np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array([text] * 100 + [text + " more"])], names=["text"]) for _ in range(3)]
    got = list(simhash._prefixes(4, none, none)(batches))
    assert sum(len(x) // 8 for b in got for x in b.column("same").to_pylist()) <= 2 * 101


def test_fingerprints_link_texts_that_are_then_compared(spark, monkeypatch):
    """Without the join, copies meet by their fingerprints alone, and are compared; without fingerprints the join still meets all."""
    rng = random.Random(4)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:200], "edit", *words[201:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k for k in range(0, 40, 2)}
    near = {k for k in want if (simhash.fingerprint(texts[k].encode()) ^ simhash.fingerprint(texts[k + 1].encode())).bit_count() <= simhash.THRESHOLD}
    assert len(near) > 3
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want
    links, prefixes = simhash.links, simhash._prefixes
    monkeypatch.setattr(simhash, "_prefixes", lambda *_: lambda batches: iter(()))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want | {k + 1 for k in want - near}
    # linked by a fingerprint of 0, but not alike: both stay
    odd = spark.createDataFrame([(1, ""), (2, "a b c")], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprint", lambda text: 0)
    assert simhash.keep_one(odd).count() == 2
    monkeypatch.setattr(simhash, "_prefixes", prefixes)
    monkeypatch.setattr(simhash, "links", lambda fps, n: links(fps.where("false"), n))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want


def test_groups_left_out_lose_no_pair():
    """Every two texts that share a shingle of their prefixes, and are of similar size, meet in some group."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(120):  # copies edited in places, appended to and cut
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, 12)):
            w[at] = f"x{rng.integers(9)}"
        texts.append(" ".join(w[: int(rng.integers(150, 401))] + [f"y{k % 7}"] * int(rng.integers(0, 40))))
    none = np.zeros(0, np.uint64)
    own = list(simhash._shingle_sets(pa.array(texts)))
    tables = [pa.Table.from_batches([b]) for b in simhash._prefixes(5, none, none)([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])]
    whole = pa.concat_tables(tables)
    met, rows = set(), 0
    for k in set(whole.column("bucket").to_pylist()):
        got = simhash._grouped(whole.filter(pa.compute.equal(whole.column("bucket"), k)))
        rows += got.num_rows
        groups = {}
        for leader, same in zip(got.column("leader").to_pylist(), got.column("same").to_pylist()):
            groups.setdefault(leader, []).append(same)
        met |= {(a, b) for g in groups.values() for a in g for b in g}
    sets = {np.int64(np.uint64(x)) if x < 2**63 else x - 2**64: s for x, s in own}
    shared = 0
    for a, x in sets.items():
        for b, y in sets.items():
            both = len(np.intersect1d(x, y))
            if a != b and both >= 0.8 * (len(x) + len(y) - both):
                assert (a, b) in met
                shared += 1
    entries = sum(len(simhash.prefix(s, none, none)) for s in sets.values())
    assert shared > 500 and rows < entries / 2
