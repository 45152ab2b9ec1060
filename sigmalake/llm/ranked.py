"""Ranked search for lexical queries: impact-ordered postings, score at a time.

Documents are indexed in blocks: a block holds, for the terms that the queries
have, which of its documents hold them and how often. N, L and the df come from
all blocks. Then each block is searched for every query: a posting's impact is
the whole-number score that it adds, a term's postings lie in groups of equal
impact, highest first, and a query takes the groups of its terms in descending
order, level by level, into accumulators. It stops only when what any document
can still gain is proven too little to enter the top k; the documents that may
be among them are then scored in full. A task keeps each query's best k from
block to block, so its later blocks stop sooner; the tasks' lists are merged by
one grouping.

A block and a task's lists are of bounded size; no step holds all documents.
Queries are taken in blocks of a bounded number of bytes, each a pass over the
documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import UPPER, arrow_rows, dropped, table, trim, written
from .packed import get, put

TOP = 10
#: Bounds of a block of documents: documents, and postings beyond which it ends with the document at hand.
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 600_000
#: Bytes of query texts taken in one pass over the documents.
QUERY_BYTES = 8_000_000
#: Levels halve from the highest impact a term has; the last takes all that is left.
LEVELS = 40

#: Bytes to spaces between terms, A to Z to small letters; everything beyond ASCII is part of a term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: A block is one row. ``postings``: document and tf of each, by term, in the numbers that ``df`` says; packed and compressed.
BLOCKS = "n_docs long, n_terms long, ids array<long>, sizes array<int>, codes array<int>, df array<int>, postings binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text: maximal runs of letters, digits and non-ASCII characters, A to Z lower-cased."""
    return text.translate(FOLD).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def measure(size, n: int, total: int):
    """m of documents with ``size`` terms."""
    return 25 + (75 * size * n) // total


def impact(w, tf, m):
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _block(ids: list, sizes: list[int], codes: list[np.ndarray], tfs: list[np.ndarray]) -> pa.RecordBatch:
    """One row: the block's documents with a term, and their postings by term."""
    code, tf = np.concatenate(codes), np.concatenate(tfs)
    doc = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
    order = np.argsort(code, kind="stable")
    held, df = np.unique(code, return_counts=True)
    postings = zstandard.ZstdCompressor(level=1).compress(put(doc[order]) + put(tf[order]))
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    lists = ((ids, pa.int64()), (sizes, pa.int32()), (held, pa.int32()), (df, pa.int32()))
    columns = [pa.array([len(ids)]), pa.array([sum(sizes)]), *(pa.array([x], pa.list_(k)) for x, k in lists), pa.array([postings])]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _indexed(vocabulary: dict[bytes, int]):
    """Documents (id, text) -> blocks. Documents without a term are nowhere."""

    def run(batches):
        ids, sizes, codes, tfs, n = [], [], [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = Counter(filter(None.__ne__, map(vocabulary.get, words)))
                ids.append(i)
                sizes.append(len(words))
                codes.append(np.fromiter(found.keys(), np.int32, len(found)))
                tfs.append(np.fromiter(found.values(), np.int32, len(found)))
                n += len(found)
                if len(ids) >= BLOCK_DOCS or n >= BLOCK_POSTINGS:
                    yield _block(ids, sizes, codes, tfs)
                    ids, sizes, codes, tfs, n = [], [], [], [], 0
        if ids:
            yield _block(ids, sizes, codes, tfs)
        trim()

    return run


class Block:
    """A block's postings with impacts: by term and falling impact, and by document."""

    def __init__(self, sizes: np.ndarray, held: np.ndarray, df: np.ndarray, postings: bytes, weights: np.ndarray, n: int, total: int):
        self.n_docs, count = len(sizes), int(df.sum())
        data = zstandard.ZstdDecompressor().decompress(postings)
        doc, tf = get(data, np.int32, count).astype(np.int64), get(data, np.int32, count, 4 * count).astype(np.int64)
        m = measure(sizes.astype(np.int64), n, total)
        slot = np.repeat(np.arange(len(held)), df)
        score = impact(weights[held][slot], tf, m[doc])
        by_term = np.lexsort((-score, slot))
        self.doc, self.score = doc[by_term], score[by_term]
        self.begin = np.cumsum(df) - df
        # a posting's level: 0 for the upper half of the highest impact, and so on; the last one takes the rest
        top = max(1, int(score.max())) if len(score) else 1
        with np.errstate(divide="ignore"):
            level = np.floor(np.log2(top / np.maximum(self.score, 1))).astype(np.int64).clip(0, LEVELS - 1)
        level[self.score == 0] = LEVELS - 1
        count = np.bincount(slot * LEVELS + level, minlength=len(held) * LEVELS).reshape(-1, LEVELS)
        #: end[t, k]: where term t's postings of levels up to k end
        self.end = self.begin[:, None] + np.cumsum(count, axis=1)
        self.levels = np.flatnonzero(count.sum(axis=0))
        self.slot_of = np.full(len(weights), -1, np.int64)
        self.slot_of[held] = np.arange(len(held))
        # by document, for full scores
        order = np.argsort(doc, kind="stable")
        self.own_slot, self.own_score = slot[order], score[order]
        size = np.bincount(doc, minlength=self.n_docs)
        self.own_end = np.cumsum(size)
        self.own_begin = self.own_end - size

    def search(self, codes: np.ndarray, times: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read) of all documents that may be among the best k and score ``floor`` or more.

        Scores are whole. ``floor`` is a score that the k best of other blocks
        reach. A document that is left out scores less than k found here or
        there do, so ties are never lost.
        """
        slot = self.slot_of[codes]
        own, times = slot[slot >= 0], times[slot >= 0]
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        at, stop = self.begin[own], self.end[own, -1]
        sums, read, least = np.zeros(self.n_docs, np.int64), 0, max(floor, 1)
        for level in self.levels:
            # the most that a document can still gain: the next impact of every term
            rest = at < stop
            left = int((self.score[at[rest]] * times[rest]).sum())
            if left < least:
                break
            to = self.end[own, level]
            size = to - at
            total = int(size.sum())
            if total:
                # all groups of equal impact down to this level, of all terms
                places = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(total)
                np.add.at(sums, self.doc[places], self.score[places] * np.repeat(times, size))
                read, at = read + total, to
                if self.n_docs > k:
                    least = max(least, int(np.partition(sums, -k)[-k]))
        rest = at < stop
        left = int((self.score[at[rest]] * times[rest]).sum())
        some = np.flatnonzero(sums + left >= least)
        if not left:
            full = sums[some]
        else:
            mult = np.zeros(len(self.begin), np.int64)
            mult[own] = times
            size = self.own_end[some] - self.own_begin[some]
            total = int(size.sum())
            places = np.repeat(self.own_begin[some] - (np.cumsum(size) - size), size) + np.arange(total)
            sums = np.concatenate([[0], np.cumsum(self.own_score[places] * mult[self.own_slot[places]])])
            ends = np.cumsum(size)
            full, read = sums[ends] - sums[ends - size], read + total
        good = full >= max(floor, 1)
        return some[good], full[good], read


class Best:
    """The best k (score, id) of a query so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # those that tie with the k-th stay
            some = scores >= np.partition(scores, -self.k)[-self.k]
            ids, scores = ids[some], scores[some]
        new = [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids.tolist())]
        self.rows = sorted(self.rows + new)[: self.k]
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def _searched(queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int):
    """Blocks -> (query, doc_id, score): of each query the best k of the task's documents."""

    def run(batches):
        best = [Best(k) for _ in queries]
        for b in batches:
            for at in range(b.num_rows):
                ids = np.array(b.column("ids")[at].as_py(), object)
                lists = (b.column(c)[at].values.to_numpy() for c in ("sizes", "codes", "df"))
                block = Block(*lists, b.column("postings")[at].as_py(), weights, n, total)
                for (codes, times), own in zip(queries, best):
                    docs, scores, _ = block.search(codes, times, own.floor, k)
                    if len(docs):
                        own.add(ids[docs], scores)
                del block
        rows = [(q, None if none else i, -s) for q, own in enumerate(best) for s, none, i in own.rows]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])
        trim()

    return run


def _query_blocks(items: DataFrame):
    """Lists of (item_id, terms with their numbers), each from at most QUERY_BYTES of texts; one longer text is a block of its own."""
    rows, size = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        if rows and size + len(r.text) > QUERY_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, Counter(terms_of(bytes(r.text)))))
        size += len(r.text) + 64
    if rows:
        yield rows


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of the documents (id, text): rows of BLOCKS."""
    return docs.mapInArrow(_indexed(vocabulary), BLOCKS)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Rank 1, 2, ... is by falling score, then id; null ids come last. Null and
    empty texts have no terms and count nowhere. Rows that repeat an id are
    documents of their own and may both be ranked; rows that repeat an item are
    ranked each. Items without a term, and an empty table, give no rows.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(query_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    out = []
    for rows in _query_blocks(asked):
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in rows for t in terms}))}
        if not vocabulary:
            continue
        blocks = written(index(d, vocabulary), "blocks")
        sizes = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
        if not sizes.n:
            dropped(blocks)
            continue
        held = blocks.select(F.explode(F.arrays_zip("codes", "df")).alias("a")).groupBy("a.codes").agg(F.sum("a.df").alias("df"))
        df = np.zeros(len(vocabulary), np.int64)
        for r in held.collect():  # a row for each term of these queries
            df[r.codes] = r.df
        weights = np.array([weight(sizes.n, int(x)) for x in df], np.int64)
        queries = [(np.array([vocabulary[t] for t in terms], np.int64), np.array([*terms.values()], np.int64)) for _, terms in rows]
        arrow_rows(spark, 1)  # a row is a block
        found = written(blocks.mapInArrow(_searched(queries, weights, sizes.n, sizes.total, k), "query int, doc_id long, score long"), "found")
        arrow_rows(spark)
        dropped(blocks)
        order = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(rows)], f"query int, item_id {kind}")
        out.append(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # a bounded block of queries
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(UPPER, UPPER.lower())
OP13_SQL = f"""with d as (select doc_id, row_number() over () row, {_TERMS} t from documents where text is not null),
own as (select doc_id, row, len(t) n, t from d where len(t) > 0),
s as (select count(*)::bigint n_docs, sum(n)::bigint total from own),
tf as (select doc_id, row, n, term, count(*)::bigint tf from (select doc_id, row, n, unnest(t) term from own) group by all),
df as (select term, count(*)::bigint df from tf group by term),
q as (select item_id, term, count(*)::bigint times from (select item_id, unnest({_TERMS}) term from benchmark where text is not null) group by all),
hit as (select item_id, doc_id, row, times * (floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) part
  from q join tf using (term) join df using (term), s),
r as (select item_id, doc_id, sum(part)::bigint score from hit group by item_id, doc_id, row having sum(part) > 0)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int rank, doc_id, score from r
qualify rank <= {TOP}"""
