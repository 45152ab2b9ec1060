"""SimHash near-dedup by anchor-point covering.

Two fingerprints within 4 bits of each other agree up to one bit in one of four
blocks. In each block the anchors are the words of a linear covering code of
radius 1: a fingerprint's home is its nearest anchor, and it is replicated to
every anchor within the radius plus the block's threshold of one bit, so the
other end of each link is met at the home of the first. All comparisons are
made per anchor; equal fingerprints are one there. Larger tables take more
blocks, some of which must agree exactly, which keeps anchors small as the
table grows and finds the same links.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_rows, components, small, table, trim, written
from .packed import get_sorted, put_sorted

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: Distinct fingerprints up to which 4, 5, 6 blocks are used.
LEVELS = (1 << 22, 1 << 31)
#: Rows that a task compares, and rows of one anchor from which it is split over tasks.
TASK_ROWS = 50_000
ANCHOR_ROWS = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles (repeats count) of ``text`` with A-Z lowered; no word: 0."""
    words = text.lower().split()  # bytes: ASCII white space and letters only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = (stop - size)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(start, stop[shingle - 1 :].tolist())], np.uint64)
    # eight counters of a byte each in a 64-bit lane, added up 255 rows at a time
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    lanes = np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0)
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        trim()

    return run


class Code:
    """Binary linear code on ``width`` bits with covering radius 1: every syndrome is the column of some bit."""

    def __init__(self, width: int):
        checks = (width + 1).bit_length() - 1
        column = [j % ((1 << checks) - 1) + 1 for j in range(width)]
        self.syndrome = np.zeros(1 << width, np.uint8)
        for j, c in enumerate(column):
            self.syndrome[1 << j : 2 << j] = self.syndrome[: 1 << j] ^ c
        self.to_home = np.array([0] + [1 << column.index(s) for s in range(1, 1 << checks)], np.uint64)
        near: list[list[int]] = [[] for _ in range(1 << checks)]
        for k in range(3):
            for bits in combinations(range(width), k):
                s = 0
                for j in bits:
                    s ^= column[j]
                near[s].append(sum(1 << j for j in bits))
        self.near = [np.array(x, np.uint64) for x in near]  # flips of at most 2 bits that lead to an anchor


class Cover:
    """The routes of a fingerprint: blocks that agree exactly, and one that agrees up to a bit."""

    def __init__(self, exact: int):
        blocks = THRESHOLD + exact
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
        self.codes = {w: Code(w) for _, w in self.blocks}
        self.routes = [(same, k) for same in combinations(range(blocks), exact) for k in range(blocks) if k not in same]
        self.rows = sum(1 + comb(self.blocks[k][1], 2) / (1 << ((self.blocks[k][1] + 1).bit_length() - 1)) for _, k in self.routes)

    def __call__(self, fps: np.ndarray):
        """Arrays (key, place in ``fps``, home) of every fingerprint at every anchor it goes to, some at a time."""
        part = [(fps >> np.uint64(at)) & np.uint64((1 << w) - 1) for at, w in self.blocks]
        for n, (same, k) in enumerate(self.routes):
            code = self.codes[self.blocks[k][1]]
            key = np.full(len(fps), n, np.uint64)
            for j in same:
                key = (key << np.uint64(self.blocks[j][1])) | part[j]
            key <<= np.uint64(self.blocks[k][1])
            s = code.syndrome[part[k]]
            home = part[k] ^ code.to_home[s]
            for syndrome, flips in enumerate(code.near):
                at = np.flatnonzero(s == syndrome)
                if len(at):
                    anchor = (part[k][at][:, None] ^ flips[None, :]).ravel()
                    i = np.repeat(at, len(flips))
                    yield key[i] | anchor, i, anchor == home[i]


def _routed(exact: int):
    def run(batches):
        cover = Cover(exact)
        for b in batches:
            fps, ids = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            for key, at, home in cover(fps):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(fps[at].view(np.int64)), pa.array(ids[at]), pa.array(home)], names=["key", "fp", "id", "home"]
                )

    return run


Pairs = tuple[np.ndarray, np.ndarray]


def near_pairs(home: np.ndarray, f: np.ndarray, threshold: int = THRESHOLD) -> Pairs:
    """Places (i, j) of links that join what is within ``threshold`` bits among ``f``, one end being a ``home``.

    Few links are returned as they are; of many, only a tree over each set that
    they connect, which takes near-linear time where a set is dense.
    """
    left, right, n = [], [], 0
    homes = np.flatnonzero(home)
    rows = max(1, (1 << 21) // max(1, len(f)))
    most = 4 * (len(homes) + len(f)) + 64
    for at in range(0, len(homes), rows):
        h = homes[at : at + rows]
        i, j = np.nonzero(np.bitwise_count(f[h][:, None] ^ f[None, :]) <= threshold)
        i = h[i]
        other = i != j
        left.append(i[other])
        right.append(j[other])
        n += int(other.sum())
        if n > most:
            return _trees(f, threshold)
    return _joined(left, right)


def _joined(left: list, right: list) -> Pairs:
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _trees(f: np.ndarray, threshold: int) -> Pairs:
    """(root, member) of every set that links connect."""
    left, right = [], []
    rest = np.arange(len(f))
    while len(rest):
        root, edge, rest = rest[0], rest[:1], rest[1:]
        while len(edge) and len(rest):
            found = []
            step = max(1, (1 << 21) // len(rest))
            for at in range(0, len(edge), step):
                if not len(rest):
                    break
                near = (np.bitwise_count(f[edge[at : at + step]][:, None] ^ f[rest][None, :]) <= threshold).any(axis=0)
                found.append(rest[near])
                rest = rest[~near]
            edge = np.concatenate(found)
            left.append(np.full(len(edge), root))
            right.append(edge)
    return _joined(left, right)


def _comparer(threshold: int):
    def run(t: pa.Table) -> pa.Table:
        key, fp, of, home = (t.column(c).to_numpy() for c in ("key", "fp", "id", "home"))
        order = np.argsort(key, kind="stable")
        key, fp, of, home = key[order], fp[order].view(np.uint64), of[order], home[order]
        cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
        left, right = [], []
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            if b - a > 1 and home[a:b].any():
                x, y = near_pairs(home[a:b], fp[a:b], threshold)
                left.append(of[a + x])
                right.append(of[a + y])
        x, y = _joined(left, right)
        pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)])[:, x != y], axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return run


def links(fps: DataFrame, n: int, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links between ids that connect the ``n`` rows (fp, id) as all links within the threshold do.

    Up to twice the blocks less one, 7 bits, four blocks meet every link; the
    finer covers of larger tables hold up to 4 bits. An anchor with more rows
    than ANCHOR_ROWS is split into a grid of home parts times replica parts,
    each met in a task of its own.
    """
    if threshold >= 2 * THRESHOLD:
        raise ValueError("four blocks meet links of up to 7 bits")
    exact = sum(n > most for most in LEVELS) if threshold <= THRESHOLD else 0
    rows = fps.select("fp", "id").mapInArrow(_routed(exact), "key long, fp long, id long, home boolean")
    homes = rows.groupBy("key").agg(F.count_if("home").alias("h"), F.count("*").alias("r")).where(F.col("r") > ANCHOR_ROWS)
    buckets = max(1, int(n * Cover(exact).rows // TASK_ROWS) + 1)
    if n > ANCHOR_ROWS // 4 and (hot := written(homes, "anchors")).limit(1).count():
        part = lambda c: F.ceil(F.col(c) / (ANCHOR_ROWS // 2)).cast("int")
        rows = rows.join(hot.select("key", part("h").alias("hs"), part("r").alias("rs")), "key", "left")
        one = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        all_of = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        hs, rs = F.greatest(F.coalesce("hs", F.lit(1)), F.lit(1)), F.coalesce("rs", F.lit(1))
        rows = rows.withColumn("hs", hs).withColumn("rs", rs)
        # a home row goes to one home part and meets all replica parts; every row is a replica too
        as_home = rows.where("home").select("key", "fp", "id", F.lit(True).alias("home"), one("hs").alias("i"), F.explode(all_of("rs")).alias("j"))
        as_other = rows.select("key", "fp", "id", F.lit(False).alias("home"), F.explode(all_of("hs")).alias("i"), one("rs").alias("j"))
        rows = as_home.union(as_other).select(F.xxhash64("key", "i", "j").alias("key"), "fp", "id", "home")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    return rows.groupBy(bucket.alias("bucket")).applyInArrow(_comparer(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), component_id (smallest id reachable over links of at most 4 bits).

    Null texts and texts without words have fingerprint 0 and link like any
    other; rows of equal texts or ids give a row each. A null id is never a
    component's id unless no other is reachable. Empty in, empty out.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    arrow_rows(docs.sparkSession)
    marked = written(d.mapInArrow(_fingerprints(shingle, SEED), "doc_id long, fp long"), "fingerprints")
    least = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    linked = components(links(least.select("fp", F.col("fp").alias("id")), least.count()))
    root = least.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    root = root.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(root, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


# --- similar texts ----------------------------------------------------------

WIDTH = 5
SIMILARITY = 0.8
#: Rows counted to find common shingles, which go last in a text's order, and how many of those are kept.
ORDER_TEXTS = 8_000
COMMON = 100_000
#: Bytes of text per bucket of shingles, shingles that a task compares, and members and shingles of a group from which it is split.
BUCKET_BYTES = 16_000_000
TASK_SHINGLES = 4_000_000
GROUP_ROWS = 2_000
GROUP_SHINGLES = 4_000_000
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _shingle_sets(texts):
    """Of each text: a hash of its word sequence, and the sorted distinct 64-bit hashes of its five-word shingles."""
    known: dict[bytes, int] = {}
    for t in texts.cast(pa.binary()):
        words = (t.as_py() or b"").lower().split()
        same = xxhash.xxh64_intdigest(b" ".join(words), 7)
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, SEED)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - WIDTH + 1)
        s = np.zeros(n, np.uint64)
        for k in range(min(WIDTH, len(h))):
            s += h[k : k + n] * PLACE[k]
        s ^= s >> np.uint64(31)
        s *= PLACE[0]
        yield same, np.unique(s ^ s >> np.uint64(29))


def _marked(batches):
    """(doc_id, text) -> a hash of the word sequence, its fingerprint, and a bound of its number of shingles; equal texts of a task are read once."""
    seen: dict[int, tuple[int, int]] = {}
    for b in batches:
        same, fp, size = [], [], []
        for t in b.column(1).cast(pa.binary()):
            text = t.as_py() or b""
            words = text.lower().split()
            key = xxhash.xxh64_intdigest(b" ".join(words), 7)
            if key not in seen:
                seen[key] = fingerprint(text), max(1, len(words) - WIDTH + 1)
            same.append(key)
            fp.append(seen[key][0])
            size.append(seen[key][1])
        same, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (same, fp))
        yield pa.RecordBatch.from_arrays([b.column(0), same, fp, pa.array(size, pa.int64())], names=["doc_id", "same", "fp", "size"])
    trim()


def _same(batches):
    """(doc_id, text) -> a hash of the word sequence."""
    for b in batches:
        words = ((t.as_py() or b"").lower().split() for t in b.column(1).cast(pa.binary()))
        same = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w), 7) for w in words), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same.view(np.int64))], names=["doc_id", "same"])
    trim()


def _counted(batches):
    """(text) -> how many texts of these batches hold each shingle."""
    own = [s for b in batches for _, s in _shingle_sets(b.column(0))]
    if own:
        shingle, n = np.unique(np.concatenate(own), return_counts=True)
        for at in range(0, len(n), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(shingle[at : at + 50_000].view(np.int64)), pa.array(n[at : at + 50_000])], names=["shingle", "n"])
    trim()


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of the shingles ``s``, common ones last, of which sets with a similarity of SIMILARITY or more share one at least.

    Any order of all shingles serves, if it is the same for all texts: a set
    that lost these from another would share less than SIMILARITY of itself.
    """
    n = len(s) - int(np.ceil(SIMILARITY * len(s) - 1e-9)) + 1
    if not len(common):
        return s[:n]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.argsort(np.where(common[at] == s, rank[at], 0), kind="stable")[:n]]


def bucket_of(shingle: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (shingle ^ shingle >> np.uint64(29)) * PLACE[1]
    return ((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _prefixes(buckets: int, common: np.ndarray, rank: np.ndarray):
    """(text) -> per bucket of shingles: those in prefixes, each with the one before it, its text's hash and size, as bytes.

    Of texts with the same words a task gives one, so a text that many rows
    repeat comes to a bucket once a task at most. Prefixes hold a text's smallest
    hashes, so buckets go by a hash of these, which is even.
    """

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            of, size, first = [], [], []
            for same, s in _shingle_sets(b.column(0)):
                if same in seen:
                    continue
                seen.add(same)
                of.append(same)
                size.append(len(s))
                first.append(prefix(s, common, rank))
            if not of:
                continue
            n = [len(f) for f in first]
            shingle = np.concatenate(first)
            of, size = np.repeat(np.array(of, np.uint64), n), np.repeat(np.array(size, np.uint32), n)
            before = np.concatenate([shingle[:1] * np.uint64(0), shingle[:-1]])
            before[np.cumsum(n) - n] = 0  # a text's first one
            bucket = bucket_of(shingle, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(k, order[x:y]) for k, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            columns = [pa.array([c[o].tobytes() for _, o in rows], pa.binary()) for c in (shingle, before, of, size)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), *columns], names=["bucket", "shingle", "before", "same", "size"])
        trim()

    return run


def _grouped(t: pa.Table) -> pa.Table:
    """A bucket of shingles -> (leader, same, size): the texts that share a shingle, under the first of them.

    Texts that share a shingle and all have the same one before it meet there
    already: such a group is left out. So copies meet at their first shingle and
    after each place where some of them differ, not at every one.
    """
    kinds = (("shingle", np.uint64), ("before", np.uint64), ("same", np.int64), ("size", np.uint32))
    shingle, before, same, size = (np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in kinds)
    order = np.lexsort((same, size, shingle))
    shingle, before, same, size = shingle[order], before[order], same[order], size[order]
    once = np.r_[True, (shingle[1:] != shingle[:-1]) | (same[1:] != same[:-1])]
    shingle, before, same, size = shingle[once], before[once], same[once], size[once]
    # similar sets are of similar size: no such pair lies across a gap
    first = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (size[:-1] < SIMILARITY * size[1:] - 1e-6)])
    n = np.diff(np.r_[first, len(shingle)])
    known = (np.minimum.reduceat(before, first) == np.maximum.reduceat(before, first)) & (before[first] != 0)
    shared = np.repeat((n > 1) & ~known, n)
    leader, same, size = np.repeat(np.minimum.reduceat(same, first), n)[shared], same[shared], size[shared]
    order = np.lexsort((same, leader))
    leader, same, size = leader[order], same[order], size[order]
    if len(leader):
        once = np.r_[True, (leader[1:] != leader[:-1]) | (same[1:] != same[:-1])]
        leader, same, size = leader[once], same[once], size[once]
    return pa.table({"leader": leader, "same": same, "size": size.astype(np.int64)})


def _sets(batches):
    """(text) -> the hash of its word sequence and 32 bits of each shingle."""
    for b in batches:
        rows = list(_shingle_sets(b.column(0)))
        same = np.array([x for x, _ in rows], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(same), pa.array([put_sorted(np.sort(s.astype(np.uint32))) for _, s in rows], pa.binary())], names=["same", "shingles"])
    trim()


def alike(sets: list[np.ndarray]) -> Pairs:
    """Places (i, j) of links of SIMILARITY or more that connect ``sets`` as all such links do."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    rest = np.argsort(size, kind="stable")
    _, code, n = np.unique(np.concatenate([sets[k] for k in rest]), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), size[rest])
    some = n[code] > 1  # what one set holds alone is in no overlap
    code, of = code[some], of[some]
    off = np.searchsorted(of, np.arange(len(sets) + 1))
    own = [code[x:y] for x, y in zip(off, off[1:])]
    of_set = dict(zip(rest.tolist(), own))
    mark, left, right = np.zeros(len(n), np.int8), [], []
    while len(rest) > 1:
        edge, rest, code, off = [int(rest[0])], rest[1:], code[off[1] - off[0] :], off[1:] - off[1]
        while edge and len(rest):
            x = edge.pop()
            sizes = size[rest]
            a = int(np.searchsorted(sizes, SIMILARITY * size[x] - 1e-6))
            b = int(np.searchsorted(sizes, size[x] / SIMILARITY + 1e-6, side="right"))
            if a >= b:
                continue
            mark[of_set[x]] = 1
            held = np.r_[0, np.cumsum(mark[code[off[a] : off[b]]], dtype=np.int64)]
            mark[of_set[x]] = 0
            both = held[off[a + 1 : b + 1] - off[a]] - held[off[a:b] - off[a]]
            found = np.zeros(len(rest), bool)
            found[a:b] = both >= SIMILARITY * (sizes[a:b] + size[x] - both) - 1e-9
            if found.any():
                edge += rest[found].tolist()
                left.append(np.full(int(found.sum()), x))
                right.append(rest[found])
                n = np.diff(off)
                code = code[np.repeat(~found, n)]
                rest, off = rest[~found], np.r_[0, np.cumsum(n[~found])]
    return _joined(left, right)


def _compared(t: pa.Table) -> pa.Table:
    """Groups of texts with their shingles -> (a, b): links that connect each group as all similar pairs do."""
    leader, x, y, same = (t.column(c).to_numpy() for c in ("leader", "x", "y", "same"))
    shingles = t.column("shingles").combine_chunks() if t.num_rows else []
    order = np.lexsort((same, y, x, leader))
    leader, x, y, same = leader[order], x[order], y[order], same[order]
    cuts = (np.flatnonzero((np.diff(leader) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist()
    left, right = [], []
    for a, b in zip([0, *cuts], [*cuts, len(same)]):
        if b - a > 1:
            i, j = alike([get_sorted(x, np.uint32, len(x) // 4) for x in shingles.take(pa.array(order[a:b])).to_pylist()])
            left.append(same[a + i])
            right.append(same[a + j])
    a, b = _joined(left, right)
    return pa.table({"a": a, "b": b})


def _parts(members: DataFrame) -> DataFrame:
    """Cells of large groups: each part of a group, with the group's leader in all."""
    columns = ("leader", "same", "size", F.col("part").alias("x"), F.col("part").alias("y"))
    led = members.where("same = leader").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return members.where("same <> leader").select(*columns).union(led.select(*columns))


def _strangers(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Cells in which members of large groups that are not linked with most of their group meet all of it.

    In a group of copies these are few, so that its rows do not grow with its square.
    """
    m = members.join(classes, F.col("same") == F.col("node"), "left").withColumn("class", F.coalesce("component", "same"))
    m = written(m.select("leader", "same", "size", "p", "part", "class"), "members")
    n = m.groupBy("leader", "class").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    most = F.max_by("class", F.struct("n", "class"))
    chunks = F.ceil(F.greatest((F.sum("n") - F.max("n")) / GROUP_ROWS, (F.sum("s") - F.max_by("s", F.struct("n", "class"))) / GROUP_SHINGLES))
    per = written(n.groupBy("leader").agg(most.alias("most"), chunks.cast("int").alias("chunks")).where("chunks > 0"), "members")
    m = m.join(small(per), "leader")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = m.where("class <> most").withColumn("x", F.pmod(F.xxhash64("same", "leader"), F.col("chunks")).cast("int")).withColumn("y", upto("p"))
    every = m.withColumn("x", upto("chunks")).withColumn("y", F.col("part"))
    columns = ("leader", "same", "size", "x", "y")
    return few.select(*columns).union(every.select(*columns)).distinct()


def _linked(texts: DataFrame) -> DataFrame:
    """(leader, same, size): the texts (same, fp, size) whose fingerprints connect by links of at most THRESHOLD bits, under the first of them."""
    least = written(texts.groupBy("fp").agg(F.min("same").alias("id")), "fingerprints")
    linked = components(links(least, least.count()))
    own = texts.join(least, "fp").join(linked, F.col("id") == F.col("node"), "left")
    own = own.select(F.coalesce("component", "id").alias("root"), "same", "size")
    led = written(own.groupBy("root").agg(F.min("same").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "fingerprints")
    return own.join(small(led), "root").select("leader", "same", "size")


def _met(own: DataFrame, cells: DataFrame) -> DataFrame:
    """Links (a, b) of the texts that meet in ``cells`` (leader, same, size, x, y); ``own`` has their sets."""
    total = cells.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("leader", "x", "y"), F.lit(int(total // TASK_SHINGLES) + 1)).cast("int").alias("bucket")
    return written(own.join(small(cells.drop("size")), "same").groupBy(bucket).applyInArrow(_compared, "a long, b long"), "pairs")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, same, component_id, first) of all rows with an id: groups linked by a Jaccard similarity of 0.8 or more on five-word shingles.

    ``same`` is a hash of the row's words and ``component_id`` the smallest id of
    its group; ``first`` is the least hash of the group's rows with that id.

    Texts with the same words (A-Z lowered) are one. Texts whose SimHash
    fingerprints connect, by the anchors of ``links``, meet in a group. What
    fingerprints miss, as those of texts near 0.8 differ in more bits, a
    set-similarity join finds, that misses no pair: two texts of that similarity share a shingle among the first
    fifth of each, in one order of all shingles. Texts that share one there go to
    the group of the first of them. In groups of both kinds all sets are compared exactly. A large
    group is compared in parts first; then those not linked with most of it meet
    all of it, in a grid of cells. Rows of a group give a tree of links, not
    pairs. Counts of some texts only choose the order.
    Texts without words are alike; shorter ones than five words are one shingle.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = written(d.mapInArrow(_marked, "doc_id long, same long, fp long, size long"), "marks")
    reps = written(marks.groupBy("same").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.min("size").alias("size")), "marks")
    n, size = d.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    some = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(n // ORDER_TEXTS + 1)) == 0).select("text")
    counted = some.mapInArrow(_counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2")
    often = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    common, rank = often.column("shingle").to_numpy().view(np.uint64), often.column("n").to_numpy()
    by = np.argsort(common)
    buckets = int(size // BUCKET_BYTES) + 1
    first = d.select("text").mapInArrow(_prefixes(buckets, common[by], rank[by]), "bucket int, shingle binary, before binary, same binary, size binary")
    shared = first.groupBy("bucket").applyInArrow(_grouped, "leader long, same long, size long")
    met = shared.union(_linked(reps.select("same", "fp", "size")))
    met = written(met.groupBy("leader", "same").agg(F.max("size").alias("size")), "groups")
    parts = F.ceil(F.greatest(F.count("*") / GROUP_ROWS, F.sum("size") / GROUP_SHINGLES)).cast("int")
    hot = written(met.groupBy("leader").agg(parts.alias("p")).where("p > 1"), "groups")
    split = not hot.isEmpty()
    cells = met.join(small(hot), "leader", "left_anti") if split else met
    cells = cells.select("leader", "same", "size", F.lit(0).alias("x"), F.lit(0).alias("y"))
    named = reps.join(small(written(met.select("same").distinct(), "met")), "same", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    own = d.join(small(written(named, "named")), "doc_id", "left_semi").select("text").mapInArrow(_sets, "same long, shingles binary")
    if marks.groupBy("doc_id").count().where("count > 1").limit(1).count():
        own = own.dropDuplicates(["same"])
    if not split:
        tree = components(_met(own, cells))
    else:
        own = written(own, "sets")
        members = met.join(small(hot), "leader").withColumn("part", F.pmod(F.xxhash64("same"), F.col("p")).cast("int"))
        cells = written(cells.unionByName(_parts(members)), "cells")
        classes = written(components(_met(own, cells)), "classes")
        rest = written(_strangers(members, classes), "cells")
        tree = components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_met(own, rest)))
    root = reps.join(tree, F.col("same") == F.col("node"), "left").select("same", "id", F.coalesce("component", "same").alias("root"))
    least = root.groupBy("root").agg(F.min(F.struct("id", "same")).alias("least"))
    root = root.select("same", "root").join(least, "root").select("same", F.col("least.id").alias("component_id"), F.col("least.same").alias("first"))
    return marks.select("doc_id", "same").join(root, "same").select(F.col("doc_id").alias(id_col), "same", "component_id", "first")


def _with_same(text_at: int, name: str):
    """Rows with a hash of their word sequence as one more column."""

    def run(batches):
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column(text_at), b.column(text_at)], names=["id", "text"])
            same = next(_same([texts])).column(1)
            yield pa.RecordBatch.from_arrays([*b.columns, same], names=[*b.schema.names, name])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those whose group of similar texts has a row that comes first.

    The smallest id comes first; of rows that repeat it, the one whose words,
    then whose columns, have the least hash. So rows that repeat an id stay if
    their texts are not similar. Rows with a null id stay.
    """
    found = written(similar_groups(docs, id_col, text_col), "components")
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        lost = found.where(F.col(id_col) != F.col("component_id")).select(id_col)
        return docs.join(small(written(lost, "lost")), id_col, "left_anti").select(docs.columns)
    columns = docs.columns
    own = "_" * (1 + max(map(len, columns)))  # longer than any column of the table
    same, row = own + "same", own + "row"
    known = docs.where(F.col(id_col).isNotNull())
    known = known.mapInArrow(_with_same(columns.index(text_col), same), StructType([*docs.schema.fields, StructField(same, LongType())]))
    stay = written(found.select(F.col("component_id").alias(id_col), F.col("first").alias(same)).distinct(), "kept")
    known = known.join(small(stay), [id_col, same], "left_semi").withColumn(row, F.xxhash64(*columns))
    known = written(known, "kept")
    least = known.groupBy(id_col, same).agg(F.min(row).alias(row))
    known = known.join(least, [id_col, same, row], "left_semi").dropDuplicates([id_col, same])
    return known.select(columns).unionByName(docs.where(F.col(id_col).isNull()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
