"""Exact substring dedup by fixed-block anchors.

Every 13-word window contains a whole block of 7 words that starts at a
multiple of 7. The index is those non-overlapping blocks of all documents; every
rolling 7-word window of every document probes it. A hit is extended to all
13-word windows around it, which are compared exactly (64-bit hashes of their
word sequences, all documents at once), and adjoining repeats merge into maximal
ones. No pair of documents is ever formed: a passage shared by n documents
costs n entries.

Keys travel as packed arrays, one row per (block of documents, bucket that the
block has keys of). A block names each of its keys once, however often it has
it, and keeps the places for itself, so a line that a third of all documents
share costs one entry per block. Buckets and blocks have a bounded size; their
number grows with the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table, trim, written
from .packed import ROW, emit, get, get_sorted, put, put_sorted, rows_of

WINDOW = 13
ANCHOR = 7
#: Words of the documents that are handled together, and bytes of text per bucket.
BLOCK_WORDS = 1_000_000
BUCKET_BYTES = 24_000_000
#: A table of ranges up to this size may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 48_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
NO_ID = np.iinfo(np.int64).max


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on; len(h) - width + 1 of them."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    k = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        k *= np.uint64(MULTIPLIER)
        k += h[j : len(h) - width + 1 + j]
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


def spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, merged half-open ranges."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.r_[True, starts[1:] > stops[:-1]]
    return starts[new], stops[np.r_[np.flatnonzero(new)[1:] - 1, len(stops) - 1]]


def places(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All places in half-open ranges."""
    n = stops - starts
    return np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _blocks(batches, columns: int, most: int):
    """Some rows at a time, up to ``most`` words or so: (64-bit hashes of all words, words of each text, other columns).

    A text's words become codes at once, so a block holds its distinct words only.
    """
    digest = xxhash.xxh64_intdigest

    def block():
        h = np.fromiter(map(digest, code), np.uint64, len(code))
        return h[np.concatenate(at)], np.fromiter(map(len, at), np.int64, len(at)), rest

    code, at, rest, n = {}, [], [[] for _ in range(columns - 1)], 0
    for b in batches:
        texts = b.column(0).cast(pa.binary())
        others = [b.column(k).to_pylist() for k in range(1, columns)]
        for i in range(b.num_rows):
            words = (texts[i].as_py() or b"").split()
            for w in dict.fromkeys(words):
                code.setdefault(w, len(code))
            at.append(np.fromiter(map(code.__getitem__, words), np.uint32, len(words)))
            for k in range(columns - 1):
                rest[k].append(others[k][i])
            n += len(words)
            if n >= most or len(at) >= 50_000:
                yield block()
                code, at, rest, n = {}, [], [[] for _ in range(columns - 1)], 0
    if at:
        yield block()


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each distinct key begins."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def cuts(sorted_buckets: np.ndarray):
    """(bucket, from, to) of the buckets that there are."""
    first = runs(sorted_buckets)
    return zip(sorted_buckets[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_buckets)])


#: Rows of a block: its keys in one bucket (answered by a bit for each), its documents, the places of its keys.
KEYS, DOCS, PLACES = range(3)


def _home(block: int, buckets: int) -> int:
    """The bucket through which a block's own rows pass; blocks of one partition spread, too."""
    return (block ^ block >> 24) % buckets


def _places(block: int, buckets: int, at: np.ndarray, size: np.ndarray, bucket: np.ndarray, more: bytes = b"") -> tuple:
    """Row of a block's places, key after key; ``bucket`` is each key's."""
    each = np.array([(b, j - i) for b, i, j in cuts(bucket)], np.int64).reshape(-1, 2)
    head = np.array([len(each), len(size), len(at)], np.int64).tobytes() + each.tobytes()
    return (_home(block, buckets), block, PLACES, len(at), head + put(size.astype(np.uint32)) + put(at.astype(np.uint32)), more)


def _answered(own: tuple, answers: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """A block's places, key after key, and which of them lie under a key whose bit is set."""
    data = own[4]
    n_buckets, n_keys, n = np.frombuffer(data, np.int64, 3).tolist()
    each = np.frombuffer(data, np.int64, 2 * n_buckets, 24).reshape(-1, 2)
    from_ = 24 + 16 * n_buckets
    size = get(data, np.uint32, n_keys, from_).astype(np.int64)
    at = get(data, np.uint32, n, from_ + 4 * n_keys).astype(np.int64)
    begin = dict(zip(each[:, 0].tolist(), (np.cumsum(each[:, 1]) - each[:, 1]).tolist()))
    good = np.zeros(n_keys, bool)
    for bucket, _, _, k, bits, _ in answers:
        i = begin[bucket]
        good[i : i + k] = np.unpackbits(np.frombuffer(bits, np.uint8), count=k)
    return at, np.repeat(good, size)


def _probes(buckets: int, anchor: int, most: int):
    """(text, row) -> per bucket: a block's 32-bit keys of rolling windows, which of them it has twice, which are anchors; per block: documents, places."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, (h, sizes, (rows,)) in enumerate(_blocks(batches, 2, most)):
            block = (part << 24) | number
            begin = np.cumsum(sizes) - sizes
            key = rolling(h, anchor)
            inside = np.arange(len(key)) - np.repeat(begin, sizes)[: len(key)]
            valid = np.flatnonzero(inside + anchor <= np.repeat(sizes, sizes)[: len(key)])
            key, inside = key[valid], inside[valid]
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.lexsort((key.astype(np.uint32), bucket)) if buckets > 1 else np.argsort(key.astype(np.uint32), kind="stable")
            low, at, fixed, bucket = key.astype(np.uint32)[order], valid[order], (inside % anchor == 0)[order], bucket[order]
            first = runs(bucket << np.uint64(32) | low)
            size = np.diff(np.r_[first, len(low)])
            yield emit([
                (_home(block, buckets), block, DOCS, len(rows), np.array(rows, np.int64).tobytes(), put(sizes.astype(np.uint32))),
                _places(block, buckets, at, size, bucket[first]),
            ])
            fixed = np.logical_or.reduceat(fixed, first) if len(first) else fixed
            low, bucket, twice = low[first], bucket[first], size > 1
            for b, i, j in cuts(bucket):
                yield emit([(b, block, KEYS, j - i, put_sorted(low[i:j]), np.packbits(np.r_[twice[i:j], fixed[i:j]]).tobytes())])
            del first, size, twice
            del h, key, inside, valid, order, low, at, fixed, bucket
            trim()

    return run


def _table(rows: list[tuple]) -> pa.Table:
    trim()
    if not rows:
        rows = [(0, 0, -1, 0, b"", b"")]
    return pa.Table.from_batches([emit(rows)])


def _bits(rows: list[tuple], hit: np.ndarray) -> list[tuple]:
    """Answers to rows of keys, in their order: a bit for each; none where no bit is set."""
    out, i = [], 0
    for bucket, block, _, n, _, _ in rows:
        mine = hit[i : i + n]
        i += n
        if mine.any():
            out.append((bucket, block, KEYS, n, np.packbits(mine).tobytes(), b""))
    return out


def _matched(t: pa.Table) -> pa.Table:
    """Per block: which of its keys some anchor has and occur more than once."""
    rows = rows_of(t)
    out = [r for r in rows if r[2] != KEYS]
    own = [r for r in rows if r[2] == KEYS]
    if own:
        keys = np.concatenate([get_sorted(r[4], np.uint32, r[3]) for r in own])
        flags = [np.unpackbits(np.frombuffer(r[5], np.uint8), count=2 * r[3]).reshape(2, -1) for r in own]
        twice, fixed = np.concatenate(flags, axis=1).astype(bool)
        order = np.argsort(keys, kind="stable")
        first = runs(keys[order])
        size = np.diff(np.r_[first, len(keys)])
        good = ((size > 1) | np.logical_or.reduceat(twice[order], first)) & np.logical_or.reduceat(fixed[order], first)
        hit = np.zeros(len(keys), bool)
        hit[order] = np.repeat(good, size)
        out += _bits(own, hit)
    return _table(out)


def _around(window: int, anchor: int):
    """Hits of a block -> per row: ranges of the windows' starts around them."""

    def run(t: pa.Table) -> pa.Table:
        rows = rows_of(t)
        keys, ranges = [], []
        docs, own = [r for r in rows if r[2] == DOCS], [r for r in rows if r[2] == PLACES]
        answers = [r for r in rows if r[2] == KEYS]
        if docs and answers:
            _, _, _, n, data, more = docs[0]
            ids, sizes = np.frombuffer(data, np.int64, n), get(more, np.uint32, n).astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            at, hit = _answered(own[0], answers)
            at = np.sort(at[hit])
            doc = np.searchsorted(begin, at, side="right") - 1
            q = at - begin[doc]
            lo, hi = np.maximum(q - (window - anchor), 0), np.minimum(q, sizes[doc] - window) + 1
            ok = lo < hi
            _ranges(keys, ranges, ids, doc[ok], lo[ok], hi[ok])
        return pa.table({"row": pa.array(keys, pa.int64()), "ranges": pa.array(ranges, pa.binary())})

    return run


def _ranges(keys, ranges, ids, doc, lo, hi):
    """Appends the merged ranges of each document."""
    if not len(doc):
        return
    far = int(hi.max()) + 1
    a, b = spans(doc * far + lo, doc * far + hi)
    d = a // far
    cuts = np.flatnonzero(np.diff(d)) + 1
    pairs = np.stack([a - d * far, b - d * far], axis=1).astype("<u4")
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)]):
        keys.append(int(ids[d[i]]))
        ranges.append(pairs[i:j].tobytes())


def _candidates(buckets: int, window: int, most: int):
    """(text, row, doc_id, ranges) -> per bucket: a block's hashes of the windows in the ranges, each with the smallest id in the block; per block: documents, places."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, (h, sizes, (rows, ids, ranges)) in enumerate(_blocks(batches, 4, most)):
            block = (part << 24) | number
            begin = np.cumsum(sizes) - sizes
            key = rolling(h, window)
            pairs = [np.frombuffer(r, "<u4").astype(np.int64).reshape(-1, 2) for r in ranges]
            count = np.array([len(p) for p in pairs], np.int64)
            all_pairs = np.concatenate(pairs)
            lift = np.repeat(begin, count)
            at = places(all_pairs[:, 0] + lift, all_pairs[:, 1] + lift)
            key = key[at]
            widths = np.add.reduceat(all_pairs[:, 1] - all_pairs[:, 0], np.r_[0, np.cumsum(count)[:-1]])
            ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            doc = ids[np.repeat(np.arange(len(rows)), widths)]
            order = np.argsort(key, kind="stable")  # buckets are ranges of the key
            key, bucket, doc = key[order], bucket[order], doc[order]
            first = runs(key)
            size = np.diff(np.r_[first, len(key)])
            least = np.minimum.reduceat(doc, first)
            within = np.packbits(doc > np.repeat(least, size)).tobytes()
            head = np.array(rows, np.int64).tobytes() + count.astype(np.int64).tobytes()
            key, bucket = key[first], bucket[first]
            yield emit([
                (_home(block, buckets), block, DOCS, len(rows), head, all_pairs.astype("<u4").tobytes()),
                _places(block, buckets, order, size, bucket, within),
            ])
            for b, i, j in cuts(bucket):
                yield emit([(b, block, KEYS, j - i, key[i:j].tobytes(), put(least[i:j].view(np.uint64)))])
            del first, size, least
            del h, key, at, doc, order, bucket
            trim()

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """Per block: which of its windows' sequences a document of another block with a smaller id than any of its own has too."""
    rows = rows_of(t)
    out = [r for r in rows if r[2] != KEYS]
    own = [r for r in rows if r[2] == KEYS]
    if own:
        keys = np.concatenate([np.frombuffer(r[4], np.uint64, r[3]) for r in own])
        docs = np.concatenate([get(r[5], np.uint64, r[3]) for r in own]).view(np.int64)
        order = np.argsort(keys, kind="stable")
        first = runs(keys[order])
        least = np.minimum.reduceat(docs[order], first)
        hit = np.zeros(len(keys), bool)
        hit[order] = np.repeat(least, np.diff(np.r_[first, len(keys)])) < docs[order]
        out += _bits(own, hit)
    return _table(out)


def _removed(window: int):
    """Repeated windows of a block -> per row: maximal ranges of words to remove."""

    def run(t: pa.Table) -> pa.Table:
        rows = rows_of(t)
        keys, ranges = [], []
        docs, own = [r for r in rows if r[2] == DOCS], [r for r in rows if r[2] == PLACES]
        if docs:
            _, _, _, n, data, more = docs[0]
            ids, count = np.frombuffer(data, np.int64).reshape(2, n)
            pairs = np.frombuffer(more, "<u4").astype(np.int64).reshape(-1, 2)
            start = places(pairs[:, 0], pairs[:, 1])
            width = np.add.reduceat(pairs[:, 1] - pairs[:, 0], np.r_[0, np.cumsum(count)[:-1]])
            doc = np.repeat(np.arange(n), width)
            at, hit = _answered(own[0], [r for r in rows if r[2] == KEYS])
            at = np.sort(at[hit | np.unpackbits(np.frombuffer(own[0][5], np.uint8), count=len(at)).astype(bool)])
            _ranges(keys, ranges, ids, doc[at], start[at], start[at] + window)
        return pa.table({"row": pa.array(keys, pa.int64()), "ranges": pa.array(ranges, pa.binary())})

    return run


def _kept(batches, at: int):
    """Text in column ``at``, ranges in the last one -> words, removed words, kept text."""
    for b in batches:
        texts, ranges = b.column(at).cast(pa.binary()), b.column(b.num_columns - 1).to_pylist()
        total, gone, kept, digest = [], [], [], []
        for t, r in zip(texts, ranges):
            t = t.as_py() or b""
            words = t.split()
            n = len(words)
            if r:
                keep, place = [], 0
                for i, j in np.frombuffer(r, "<u4").reshape(-1, 2).tolist():
                    keep += words[place:i]
                    place = j
                words = keep + words[place:]
            whole = b" ".join(words)
            total.append(n)
            gone.append(n - len(words))
            kept.append(whole)
            digest.append(hashlib.sha256(whole).hexdigest())
        yield b, total, gone, kept, digest


def _finish(with_text: bool):
    def run(batches):
        for b, total, gone, kept, digest in _kept(batches, 1):
            columns = [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept")
            for i in range(0, b.num_rows, 500 if with_text else b.num_rows):
                yield pa.RecordBatch.from_arrays([c.slice(i, 500 if with_text else b.num_rows) for c in columns], names=names)

    return run


def _joined(left: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """By row key; the ranges are broadcast only if their measured size allows it, else both sides are shuffled."""
    size = ranges.agg(F.coalesce(F.sum(F.length("ranges") + 80), F.lit(0))).first()[0]
    return left.join(F.broadcast(ranges) if size <= BROADCAST_BYTES else ranges, "row", how)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row, ranges) of the rows (row, doc_id, text) with words to remove: little-endian pairs of 32-bit word places."""
    arrow_rows(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(size // BUCKET_BYTES) + 1
    probes = docs.select("text", "row").mapInArrow(_probes(buckets, anchor, BLOCK_WORDS), ROW)
    hits = probes.groupBy("bucket").applyInArrow(_matched, ROW).where("kind >= 0")
    near = hits.groupBy("block").applyInArrow(_around(window, anchor), "row long, ranges binary")
    near = written(near.dropDuplicates(["row"]), "anchors")
    own = _joined(docs, near, "inner").select("text", "row", "doc_id", "ranges")
    found = own.mapInArrow(_candidates(buckets, window, BLOCK_WORDS), ROW)
    found = found.groupBy("bucket").applyInArrow(_repeated, ROW).where("kind >= 0")
    gone = found.groupBy("block").applyInArrow(_removed(window), "row long, ranges binary")
    return written(gone.dropDuplicates(["row"]), "repeats")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256[, kept].

    A word goes if some window over it also starts in a document with a smaller
    id; windows are judged on the input. Null texts have no words; texts shorter
    than a window keep all. A null id counts as larger than any. Rows with the
    same id never remove each other's words. ``kept`` is the kept words joined
    by one space. An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("row", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(d, window)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return _joined(d, ranges, "left").select("doc_id", "text", "ranges").mapInArrow(_finish(with_text), schema)


def _replaced(text_at: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                whole = part.column(text_at).to_pylist()
                for rest, _, gone, kept, _ in _kept([part], text_at):
                    texts = [k.decode() if g else t for k, g, t in zip(kept, gone, whole)]
                columns = [pa.array(texts, pa.string()) if k == text_at else rest.column(k) for k in range(rest.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(columns, names=rest.schema.names[:-1])

    return run


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but for texts that lose words: those are their kept words joined by one space."""
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    d = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    mine = "_" * (1 + max(map(len, docs.columns)))  # longer than any column of the table
    key, gone = mine + "row", mine + "ranges"
    side = repeated_ranges(d, window).select(F.col("row").alias(key), F.col("ranges").alias(gone))
    own = docs.withColumn(key, row)
    size = side.agg(F.coalesce(F.sum(F.length(gone) + 80), F.lit(0))).first()[0]
    own = own.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, key, "left")
    own = own.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in docs.columns], gone)
    at = docs.columns.index(text_col)
    return own.mapInArrow(_replaced(at), docs.schema)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


OP8_SQL = r"""
with d as (select row_number() over () r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') k from (select *, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
m as (select k, min(doc_id) least from s group by k),
hit as (select r, i from s join m using (k) where doc_id > least or (doc_id is null and least is not null)),
gone as (select distinct r, i + unnest(range(0, 13)) p from hit),
each as (select r, unnest(w) x, unnest(range(1, len(w) + 1)) p from d),
kept as (select r, string_agg(x, ' ' order by p) t, count(*) n from each anti join gone using (r, p) group by r)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (r)
"""
