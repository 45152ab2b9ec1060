"""Best-fit packing by sums of squares.

Texts become token ids and are cut only where they exceed a sequence. Pieces
are dealt over shards of bounded size; a shard keeps, per residual gap, the
count of its open sequences and puts each piece, longest first, where the
squared counts become smallest. A shard leaves some two or three sequences'
worth of gaps behind, under 0.03 % of a full shard; the number of shards grows
with the table, their size does not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table, trim, written

CAPACITY = 4096
END = 1
#: Pieces a shard holds; with 4,096 gaps this keeps a shard within some MB.
SHARD = 60_000
#: Words whose ids a worker remembers, and as many from before those; a chunk of texts adds its own.
REMEMBERED = 400_000
CHUNK_BYTES = 8_000_000
VOCABULARY = "word_bpe_49k.json"

#: Marks that a word may end in; no apostrophe, which some pre-tokens start with.
MARKS = b".,!?;:#$%&*|)]}-+=/"
MARK_BYTES = frozenset(MARKS)
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids:
    """Bytes of a word -> bytes of its ids. The tokenizer drops white space and joins nothing across it."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the words known before these: those met again stay
        vocabulary_ids = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary_ids.values()) + 1, bool)  # ids that end a pre-token
        for token, i in vocabulary_ids.items():
            self.last[i] = token.endswith("</w>")

    def recall(self, words: set[bytes]) -> None:
        before = self.before
        self.known.update([(w, before[w]) for w in words if w in before])

    def learn(self, fresh: set[bytes]) -> None:
        """Adds words to ``known``. ASCII marks after an ASCII letter are looked up on their own: a pre-token ends there."""
        known, ends, whole = self.known, [], set()
        rest = []
        for w in fresh:
            if w[-1] in MARK_BYTES and (stem := w.rstrip(MARKS)) and stem[-1] in LETTERS:
                ends.append((w, stem))
                whole.add(w[len(stem) :])
            else:
                rest.append(w)
        whole.update(rest, [stem for _, stem in ends])
        whole.difference_update(known)
        self.recall(whole)
        whole.difference_update(known)
        plain = [w for w in whole if w.isalpha()]  # ASCII letters
        odd = []
        for w in whole.difference(plain):
            (plain if w.decode().isalpha() else odd).append(w)
        # a word of letters alone is one pre-token, so many share a call
        for at in range(0, len(plain), 40_000):
            groups = [plain[i : i + 400] for i in range(at, min(at + 40_000, len(plain)), 400)]
            got = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
            for group, e in zip(groups, got):
                ids = np.array(e.ids, "<u4")
                ends_at = 4 * (np.flatnonzero(self.last[ids]) + 1)
                if len(ends_at) != len(group):
                    odd += group
                    continue
                ids, stops = ids.tobytes(), ends_at.tolist()
                known.update(zip(group, [ids[i:j] for i, j in zip([0, *stops], stops)]))
        for at in range(0, len(odd), 20_000):
            some = odd[at : at + 20_000]
            got = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            for w, e in zip(some, got):
                known[w] = np.array(e.ids, "<u4").tobytes()
        for w, stem in ends:
            known[w] = known[stem] + known[w[len(stem) :]]

    def texts(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; every distinct word of them is looked up once."""
        # lower case first, as the tokenizer does, but for texts that may spell a special token
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(low)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known = self.known
        known[b""] = b""
        found = list(map(known.get, words))
        if None in found:
            missing = {w for w, f in zip(words, found) if f is None}
            self.recall(missing)
            self.learn(missing.difference(known))
            found = list(map(known.__getitem__, words))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(found), "<u4")
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        place = np.repeat(begin[code] - (ends - n), n)
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        del low, split, coded, words, found, size, begin, code, n, ends  # a worker's peak is here
        place += np.arange(len(place))
        ids = ids[place]
        del place
        for i, j in zip(bounds, bounds[1:]):
            yield ids[i:j].tobytes()


#: What a Python worker keeps from task to task: a tokenizer and its known words.
_WORKER: dict[str, _Ids] = {}


def _pieces(capacity: int, end: int, vocabulary: str, with_ids: bool):
    last = np.array([end], "<u4").tobytes()
    step, width = 4 * capacity, 5 + with_ids

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary not in _WORKER:
            _WORKER[vocabulary] = _Ids(vocabulary)
        ids = _WORKER[vocabulary]
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            doc_ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            at = 0
            while at < len(texts):  # some MB of text at a time, at least a text
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
                for doc, all_ids in zip(doc_ids[at:to], ids.texts(texts[at:to])):
                    all_ids += last
                    for n, i in enumerate(range(0, len(all_ids), step)):
                        part = all_ids[i : i + step]
                        out.append((doc, n, i // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)[:width])
                at = to
                if len(out) >= 20_000 or with_ids:
                    yield _batch(out, width)
                    out = []
            if out:
                yield _batch(out, width)
            trim()

    return run


def _batch(rows: list[tuple], width: int) -> pa.RecordBatch:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:width]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:width]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end: int = END, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs``: its ids and the end id, cut at ``capacity``."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_pieces(capacity, end, vocabulary, with_ids), PIECES + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length in the given order, and the fill of each bin.

    State: the count of open bins per gap. A length s that goes into gap g
    changes the sum of squares by 2 * (n[g - s] - n[g] + 1), an exact fit by
    1 - 2 * n[g], a new bin by 2 * n[capacity - s] + 1; the least change wins,
    among equals the smallest gap.
    """
    n = np.zeros(capacity + 1, np.int64)
    blocked = np.full(capacity + 1, -(1 << 40), np.int64)  # n where it is over 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        g, best = -1, None
        if s < capacity:
            change = 2 * (n[: capacity - s] - blocked[s:capacity]) + 2
            change[0] -= 1  # n[0] is always 0: a full bin is no longer open
            i = int(change.argmin())
            best = int(change[i])
            if best < (1 << 39):
                g = s + i
            if g >= 0 and best >= 2 * int(n[capacity - s]) + 1:
                g = -1
        if g < 0:
            b, gap = len(fill), capacity
            fill.append(0)
        else:
            b, gap = open_bins[g].pop(), g
            n[g] -= 1
            blocked[g] = n[g] if n[g] else -(1 << 40)
        bins[k], offsets[k] = b, capacity - gap
        fill[b] += s
        if gap := gap - s:
            open_bins[gap].append(b)
            n[gap] += 1
            blocked[gap] = n[gap]
    return bins, offsets, np.array(fill, np.int64)


def _place(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, _ = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["shard"] * (1 << 32) + bins, offset=offsets).drop(columns="shard")

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
         vocabulary: str | None = None, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Every row of ``docs`` gives at least one piece: a null or empty text is its
    end id alone. Rows that repeat an id are packed each on their own; a null
    id stays null; equal rows, however many, are dealt over all shards. An empty
    table gives no pieces. ``with_ids`` adds the
    little-endian 32-bit ids themselves, from which a writer can lay out whole
    sequences by (sequence_id, offset).
    """
    arrow_rows(docs.sparkSession, 4_000)
    p = pieces(docs, id_col, text_col, capacity, end, vocabulary, with_ids).withColumn("place", F.monotonically_increasing_id())
    p = written(p, "pieces")
    shards = max(1, -(-p.count() // shard))
    of = lambda *by: F.pmod(F.xxhash64(*by), F.lit(shards)).cast("long")
    dealt = p.withColumn("shard", of("doc_id", "piece", "ids_crc32"))
    if shards > 1 and (dealt.groupBy("shard").count().agg(F.max("count")).first()[0] or 0) > 1.25 * shard:
        dealt = p.withColumn("shard", of("doc_id", "piece", "ids_crc32", "place"))  # many equal rows: dealt by their places
    dealt = dealt.drop("place")
    schema = PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(_place(capacity), schema)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
