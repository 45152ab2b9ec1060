"""LM scoring with a hierarchical Pitman-Yor model.

Restaurants: one per context, a context being the whole word before. Words
with the same last two bytes share a parent, those with the same last byte a
grandparent, and all share the restaurant of single words, whose base is
uniform. Restaurants of words grow with the vocabulary; the 65,793 above them
smooth what a rare word before cannot tell.

Tables are sampled by block Gibbs sweeps: the customers of each dish leave their
restaurant and its parent, and are seated again one by one, given all others as
the sweep before left them; the tables are the parent's customers. Restaurants
span all buckets of words: before each sweep their totals are summed over all
of them (those of words by a shuffle on the context, the few others on the
driver), and random numbers belong to dishes, so the scores do not depend on how
words are dealt over buckets. Predictive probabilities are averaged over several
samples.

Counts move as packed arrays, one row per (block of documents, bucket of
words): first the distinct (word, context) pairs of a block to the buckets,
then one probability for each back to the block, which knows their places.
A bucket's pairs are written once, its tables after every sweep.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import new_path
from .common import arrow_rows, deleted, dropped, fold_of, table, trim, written
from .packed import ROW, emit, get, get_sorted, put, put_sorted, rows_of

HELD_OUT = 1
BURN_IN = 2
SAMPLES = 3
SEED = 5
STRENGTH = (10.0, 2.0, 2.0)
#: Strength of the restaurants of whole words.
WORD_STRENGTH = 2.0
#: Words of the documents that are handled together, and bytes of text per bucket of words.
BLOCK_WORDS = 1_000_000
BLOCK_DOCS = 1 << 18
BUCKET_BYTES = 12_000_000
#: Contexts that a pair names in two bytes, the most frequent of some SAMPLE texts; others take eight. Only sizes depend on them.
BOOK = 65_535
SAMPLE = 8_000
#: The context of a text's first word, and the mark before a word of one byte: bytes that no word has.
START = 0x0A0A
SHORT = 0x20
END_HASH = xxhash.xxh64_intdigest(b"\n", 1)

PAIRS, PLACES, DOCS, ANSWER, STRUCTURE, INDEX, STATE, TABLES, REPLY, TOTAL = range(10)
MERGED = "bucket int, block array<long>, n array<int>, data array<binary>, more array<binary>"


def suffix_of(names: np.ndarray) -> np.ndarray:
    """The last two bytes of the words that ``names`` stand for, the last one low."""
    top = (names >> np.uint64(32)).astype(np.int64)
    return (top & 0xFF) << 8 | top >> 8


def tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, one after the other: distinct word hashes; names of these words as contexts, and of a text's start, which
    is the last; each token's word, word before and text. A text ends in its end token.

    A name has 48 bits: the word's last byte, the one before, 32 bits of the whole word's hash.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words))
    hashes = np.append(hashes, np.uint64(END_HASH))
    off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(1, np.uint8)
    size = np.diff(off)
    last = raw[np.maximum(off[1:] - 1, 0)].astype(np.int64)
    other = np.where(size > 1, raw[np.maximum(off[1:] - 2, 0)], SHORT).astype(np.int64)
    low = hashes & np.uint64(0xFFFFFFFF)
    top = np.r_[last << 8 | other, 0].astype(np.uint64)
    names = np.append(top << np.uint64(32) | low, np.uint64(START << 32))
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = size[code] > 0 if len(size) else np.zeros(0, bool)
    code, doc = code[real], doc[real]
    n = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(n)
    code = np.insert(code, ends, len(words))
    doc = np.insert(doc, ends, np.arange(len(texts)))
    before = np.empty(len(code), np.int64)
    if len(code):
        before[1:] = code[:-1]
        before[(ends - n) + np.arange(len(texts))] = len(names) - 1
    return hashes, names, code, before, doc


def _blocks(batches):
    """(texts, ids, training) of some documents at a time."""
    for b in batches:
        texts = b.column(0)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            most = (size[at - 1] if at else 0) + 6 * BLOCK_WORDS
            to = min(max(at + 1, int(np.searchsorted(size, most, side="right"))), at + BLOCK_DOCS)
            yield texts[at:to], b.column(1)[at:to], b.column(2)[at:to]
            at = to


def _gather(buckets: int, book: np.ndarray | None = None):
    """(text, doc_id, training) -> per bucket: the block's pairs; per block and bucket: their places; per block: its documents.

    Contexts are whole words, those in ``book`` (sorted names) as their places there; without a book, last two bytes.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, (texts, ids, training) in enumerate(_blocks(batches)):
            block = (part << 24) | number
            hashes, names, code, before, doc = tokens(texts)
            train = training.to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes = hashes[order]
            if book is None:
                context, bits = suffix_of(names)[before], 16
            else:
                by_name = np.argsort(names)
                place = np.empty(len(names), np.int64)
                place[by_name] = np.arange(len(names))
                context, bits, names = place[before], len(hashes).bit_length(), names[by_name]
            # (word, context, document) in one number each, sorted at once; buckets are ranges of the hash. A block
            # of several documents has under 2 ** 21 different words, one of a single document has no document bits
            doc_bits = (len(texts) - 1).bit_length()
            s = np.sort((rank[code] << bits | context) << doc_bits | doc)
            doc_s, pair_s = s & ((1 << doc_bits) - 1), s >> doc_bits
            first = np.flatnonzero(np.r_[True, pair_s[1:] != pair_s[:-1]])
            pair, count = pair_s[first], np.diff(np.r_[first, len(s)])
            trained = np.add.reduceat(train[doc_s].astype(np.int64), first)
            word, ctx = pair >> bits, pair & ((1 << bits) - 1)
            if book is None:
                ctx, rest = ctx.astype(np.uint16), np.zeros(0, np.uint64)
            else:
                at = np.searchsorted(book, names)
                known = np.append(book, np.uint64(0))[at] == names
                named, ctx = names[ctx], np.where(known, at + 1, 0).astype(np.uint16)[ctx]
                rest = named[ctx == 0]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            # only buckets that the block has words of: rows grow with its words, not with the number of buckets
            present, from_ = np.unique(bucket, return_index=True)
            word_cuts = np.r_[from_, len(hashes)]
            pair_cuts = np.searchsorted(word, word_cuts)
            place_cuts = np.r_[first, len(s)][pair_cuts]
            rest_cuts = np.r_[0, np.cumsum(ctx == 0)][pair_cuts] if len(rest) else np.zeros(len(pair_cuts), np.int64)
            n_tokens = np.bincount(doc, minlength=len(texts))
            known_ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            missing = pc.is_null(ids).to_numpy(zero_copy_only=False)
            yield emit([(0, block, DOCS, len(texts), known_ids.tobytes() + put(n_tokens.astype(np.uint32)), missing.tobytes() + train.tobytes())])
            for k, b in enumerate(present.tolist()):
                (w0, w1), (p0, p1), (o0, o1), (r0, r1) = (c[k : k + 2] for c in (word_cuts, pair_cuts, place_cuts, rest_cuts))
                if p1 > p0:
                    per_word = np.bincount(word[p0:p1] - w0, minlength=w1 - w0).astype(np.uint32)
                    data = hashes[w0:w1].tobytes() + put(per_word)
                    more = put(ctx[p0:p1]) + put(trained[p0:p1].astype(np.uint32)) + put(rest[r0:r1])
                    yield emit([(b, block, PAIRS, int(w1 - w0), data, more)])
                    yield emit([(b, block, PLACES, int(p1 - p0), put(count[p0:p1].astype(np.uint32)), put(doc_s[o0:o1].astype(np.uint32)))])
            del hashes, names, code, before, context, doc, rank, order, s, rest, doc_s, pair_s, first, pair, count, trained, word, ctx
            trim()

    return run


def uniforms(dish: np.ndarray, step: int) -> np.ndarray:
    """A random number in (0, 1) for each dish (64 bits that name it) and step: always the same one."""
    x = dish + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def binomial(m: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The binomial quantile of ``u``, by adding up probabilities; where some 30 or more are expected, by the normal curve."""
    k = np.zeros(len(m), np.int64)
    p = np.minimum(p, 1 - 1e-12)
    many = m * p > 30
    if many.any():
        # a sum of uniform numbers drawn from the bits of u stands for a normal one
        bits = (u[many] * 2.0**53).astype(np.uint64)
        z = sum(uniforms(bits, j) for j in range(12)) - 6
        mean = m[many] * p[many]
        k[many] = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - p[many]))), 0, m[many])
    at = np.flatnonzero(~many)
    odds = p[at] / (1 - p[at])
    term = (1 - p[at]) ** m[at]
    rest = u[at] - term
    while len(more := np.flatnonzero((rest > 0) & (k[at] < m[at]))):
        at, odds, term, rest = at[more], odds[more], term[more], rest[more]
        term = term * odds * (m[at] - k[at]) / (k[at] + 1)
        k[at] += 1
        rest = rest - term
    return k


def seat(customers: np.ndarray, push: np.ndarray, step: np.ndarray, discount: float, dish: np.ndarray) -> np.ndarray:
    """Tables of each dish, its customers seated one by one.

    ``push`` is (strength + discount x tables of the other dishes) x the parent's
    probability, ``step`` the discount x that probability. Customer n + 1 of a
    dish with t tables opens a new one with odds push + step x t : n - discount x t.
    From the 65th customer on, 1/32 of the seated are drawn at once.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(-customers[order], kind="stable")]
    c, a, b, d = customers[order], push[order], step[order], dish[order]
    t = tables[order]
    n = 1
    active = int(np.searchsorted(-c, -n, side="left"))  # those with more than n customers
    while active:
        m = 1 if n < 64 else n // 32
        odds = a[:active] + b[:active] * t[:active]
        p = odds / (n - discount * t[:active] + odds)
        u = uniforms(d[:active], n)
        t[:active] += u < p if m == 1 else binomial(np.minimum(m, c[:active] - n), p, u)
        n += m
        active = int(np.searchsorted(-c, -n, side="left"))
    tables[order] = t
    return tables


def _discount(customers: np.ndarray) -> tuple[int, int]:
    return int((customers == 1).sum()), int((customers == 2).sum())


def _rate(once: float, twice: float) -> float:
    """Discount from how many dishes have one and two customers."""
    return float(np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.95))


class Bucket:
    """All pairs of a bucket's words, and the seating of their training occurrences."""

    def __init__(self, rows: list[tuple]):
        hashes, words, ctxs, counts, self.sizes = [], [], [], [], []
        base = 0
        for _, block, _, n, data, more in rows:
            h = np.frombuffer(data, np.uint64, n)
            per_word = get(data, np.uint32, n, 8 * n).astype(np.int64)
            p = int(per_word.sum())
            hashes.append(h)
            words.append(np.repeat(np.arange(n), per_word) + base)
            ctxs.append(get(more, np.uint16, p).astype(np.int64))
            counts.append(get(more, np.uint32, p, 2 * p).astype(np.int64))
            self.sizes.append((block, n, p))
            base += n
        all_hashes = np.concatenate(hashes)
        self.hashes, of = np.unique(all_hashes, return_inverse=True)
        self.word_of = of  # of each block's words
        pair = of[np.concatenate(words)] << 16 | np.concatenate(ctxs)
        pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.word, self.k2 = pairs >> 16, pairs & 0xFFFF
        self.c2 = np.bincount(self.pair_of, np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
        mid, self.mid_of = np.unique(self.word << 8 | self.k2 & 0xFF, return_inverse=True)
        self.mid_word, self.k1 = mid >> 8, mid & 0xFF
        self.count = np.bincount(self.word, self.c2, minlength=len(self.hashes)).astype(np.int64)

    def states(self, totals: list):
        """Yields (t2, c1, t1, c0, t0): the first seating, one table a dish, and that after a sweep with each of ``totals``."""
        n_words, n_mid = len(self.hashes), len(self.mid_word)
        ones = lambda c: np.minimum(c, 1)
        t2 = ones(self.c2)
        c1 = np.bincount(self.mid_of, t2, minlength=n_mid).astype(np.int64)
        t1 = ones(c1)
        c0 = np.bincount(self.mid_word, t1, minlength=n_words).astype(np.int64)
        t0 = ones(c0)
        yield t2, c1, t1, c0, t0
        for sweep, total in enumerate(totals):
            t2, c1, t1, c0, t0 = self.swept((t2, c1, t1, c0, t0), total, sweep)
            yield t2, c1, t1, c0, t0

    def names(self, level: int, key: np.ndarray, of: np.ndarray) -> np.ndarray:
        """64 bits that name the dish of each word in the restaurant ``key``."""
        return self.hashes[of] ^ (key.astype(np.uint64) << np.uint64(8) | np.uint64(level)) * np.uint64(0xD6E8FEB86659FD93)

    def swept(self, state: tuple, total: "Totals", sweep: int) -> tuple:
        """The seating after one more sweep; ``self.c2`` are the customers to seat."""
        t2, c1, t1, c0, t0 = state
        n_words, n_mid = len(self.hashes), len(self.mid_word)
        mid, word, k1 = self.mid_of, self.mid_word, self.k1
        dish2, dish1, dish0 = self.names(2, self.k2, self.word), self.names(1, k1, word), self.hashes
        (s0, s1, s2) = STRENGTH
        (d2, d1, d0), uniform, at = total.d, 1 / (total.v + 1), np.uint64(SEED + sweep << 32)
        (_, all_c1, (all_c0,)), (all_t2, all_t1, (all_t0,)) = total.c, total.t
        p0 = (c0 - d0 * t0 + (s0 + d0 * all_t0) * uniform) / (s0 + all_c0)
        # each probability as it is without the dish's own tables
        c, t = c1[mid] - t2, np.minimum(t1[mid], c1[mid] - t2)
        p = (c - d1 * t + (s1 + d1 * all_t1[k1][mid]) * p0[word][mid]) / (s1 + all_c1[k1][mid] - t2)
        new2 = seat(self.c2, (s2 + d2 * (all_t2[self.k2] - t2)) * p, d2 * p, d2, dish2 + at)
        c, t = c0[word] - t1, np.minimum(t0[word], c0[word] - t1)
        p = (c - d0 * t + (s0 + d0 * all_t0) * uniform) / (s0 + all_c0 - t1)
        c1 = np.bincount(mid, new2, minlength=n_mid).astype(np.int64)
        new1 = seat(c1, (s1 + d1 * (all_t1[k1] - t1)) * p, d1 * p, d1, dish1 + at)
        c0 = np.bincount(word, new1, minlength=n_words).astype(np.int64)
        p = np.full(n_words, uniform)
        return new2, c1, new1, c0, seat(c0, (s0 + d0 * (all_t0 - t0)) * p, d0 * p, d0, dish0 + at)

    def parents(self, state: tuple, total: "Totals") -> np.ndarray:
        """Predictive probability of each word after a last byte."""
        _, c1, t1, c0, t0 = state
        (_, d1, d0), (_, all_c1, (all_c0,)), (_, all_t1, (all_t0,)) = total.d, total.c, total.t
        p0 = (c0 - d0 * t0 + (STRENGTH[0] + d0 * all_t0) / (total.v + 1)) / (STRENGTH[0] + all_c0)
        return (c1 - d1 * t1 + (STRENGTH[1] + d1 * all_t1[self.k1]) * p0[self.mid_word]) / (STRENGTH[1] + all_c1[self.k1])

    def probabilities(self, state: tuple, total: "Totals") -> np.ndarray:
        """Predictive probability of each pair under one seating."""
        t2, d2 = state[0], total.d[0]
        p1 = self.parents(state, total)
        return (self.c2 - d2 * t2 + (STRENGTH[2] + d2 * total.t[0][self.k2]) * p1[self.mid_of]) / (STRENGTH[2] + total.c[0][self.k2])


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and each entry's run."""
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Words(Bucket):
    """A bucket's pairs of a word and the whole word before, ``word3`` and ``ctx`` (a place in ``contexts``), on top of the suffix levels.

    Pairs are sorted by word and context name, so the pairs of each level lie together.
    """

    def __init__(self, hashes: np.ndarray, contexts: np.ndarray, word3: np.ndarray, ctx: np.ndarray, c3: np.ndarray):
        self.hashes, self.contexts, self.word3, self.ctx, self.c3 = hashes, contexts, word3, ctx, c3
        k2 = suffix_of(contexts)[ctx]
        first, self.up = _starts(word3 << 16 | k2)
        self.word, self.k2 = word3[first], k2[first]
        first, self.mid_of = _starts(self.word << 8 | self.k2 & 0xFF)
        self.mid_word, self.k1 = self.word[first], self.k2[first] & 0xFF
        self.count = np.bincount(word3, c3, minlength=len(hashes)).astype(np.int64)
        self.more = np.flatnonzero(c3 > 1)  # one customer has one table

    @classmethod
    def gathered(cls, rows: list[tuple], book: np.ndarray) -> tuple["Words", list[tuple[int, np.ndarray]]]:
        """From rows of PAIRS; also (block, place of each of its pairs) for every block."""
        hashes, words, named, counts, sizes = [], [], [], [], []
        base = 0
        for _, block, _, n, data, more in rows:
            per_word = get(data, np.uint32, n, 8 * n).astype(np.int64)
            p = int(per_word.sum())
            code = get(more, np.uint16, p).astype(np.int64)
            rest = code == 0
            name = np.append(np.uint64(0), book)[code]
            name[rest] = get(more, np.uint64, int(rest.sum()), 6 * p)
            hashes.append(np.frombuffer(data, np.uint64, n))
            words.append(np.repeat(np.arange(n), per_word) + base)
            named.append(name)
            counts.append(get(more, np.uint32, p, 2 * p))
            sizes.append((block, p))
            base += n
        known, of = np.unique(np.concatenate(hashes), return_inverse=True)
        contexts, ctx = np.unique(np.concatenate(named), return_inverse=True)
        del hashes, named
        bits = len(contexts).bit_length()
        pairs, places = np.unique(of[np.concatenate(words)] << bits | ctx, return_inverse=True)
        del words, ctx, of
        c3 = np.bincount(places, np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
        cuts = np.cumsum([p for _, p in sizes])[:-1]
        blocks = [(block, x.astype(np.uint32)) for (block, _), x in zip(sizes, np.split(places, cuts))]
        return cls(known, contexts, pairs >> bits, pairs & ((1 << bits) - 1), c3), blocks

    def packed(self) -> tuple[int, bytes, bytes]:
        head = np.array([len(self.hashes), len(self.contexts)], np.int64).tobytes()
        per_word = np.bincount(self.word3, minlength=len(self.hashes)).astype(np.uint32)
        more = put_sorted(self.contexts) + put_sorted(self.ctx.astype(np.uint32)) + put(self.c3.astype(np.uint32))
        return len(self.c3), head + self.hashes.tobytes() + put(per_word), more

    @classmethod
    def unpacked(cls, n: int, data: bytes, more: bytes) -> "Words":
        n_words, n_ctx = np.frombuffer(data, np.int64, 2).tolist()
        hashes = np.frombuffer(data, np.uint64, n_words, 16)
        word3 = np.repeat(np.arange(n_words), get(data, np.uint32, n_words, 16 + 8 * n_words))
        contexts = get_sorted(more, np.uint64, n_ctx)
        ctx = get_sorted(more, np.uint32, n, 8 * n_ctx).astype(np.int64)
        return cls(hashes, contexts, word3, ctx, get(more, np.uint32, n, 8 * n_ctx + 4 * n).astype(np.int64))

    def seated(self, t3: np.ndarray, t2: np.ndarray, t1: np.ndarray, t0: np.ndarray) -> tuple:
        """(t3, (t2, c1, t1, c0, t0)) from tables alone; sets ``c2``, the tables of words, which are the suffix level's customers."""
        self.c2 = np.bincount(self.up, t3, minlength=len(self.word)).astype(np.int64)
        c1 = np.bincount(self.mid_of, t2, minlength=len(self.mid_word)).astype(np.int64)
        c0 = np.bincount(self.mid_word, t1, minlength=len(self.hashes)).astype(np.int64)
        return t3, (t2, c1, t1, c0, t0)

    def first(self) -> tuple:
        """One table a dish."""
        some = lambda of, t, n: np.minimum(np.bincount(of, t, minlength=n), 1).astype(np.int64)
        t3 = np.minimum(self.c3, 1)
        t2 = some(self.up, t3, len(self.word))
        t1 = some(self.mid_of, t2, len(self.mid_word))
        return self.seated(t3, t2, t1, some(self.mid_word, t1, len(self.hashes)))

    def sweep(self, t3: np.ndarray, state: tuple, total: "Totals", all_t3: np.ndarray, number: int) -> tuple:
        """Whole words first, then their tables on the suffix levels. ``all_t3`` are the tables of each context in all buckets."""
        t2, d3, d2, at = state[0], total.word_d, total.d[0], self.more
        up, ctx, own = self.up[at], self.ctx[at], t3[at]
        k2 = self.k2[up]
        # the parent's probability as it is without the dish's own tables
        c, t = self.c2[up] - own, np.minimum(t2[up], self.c2[up] - own)
        p = (c - d2 * t + (STRENGTH[2] + d2 * total.t[0][k2]) * self.parents(state, total)[self.mid_of[up]]) / (STRENGTH[2] + total.c[0][k2] - own)
        dish = self.names(3, self.contexts[ctx], self.word3[at]) + np.uint64(SEED + number << 32)
        new = np.minimum(self.c3, 1)
        new[at] = seat(self.c3[at], (WORD_STRENGTH + d3 * (all_t3[ctx] - own)) * p, d3 * p, d3, dish)
        self.c2 = np.bincount(self.up, new, minlength=len(self.word)).astype(np.int64)
        return new, self.swept(state, total, number)

    def word_probabilities(self, t3: np.ndarray, state: tuple, total: "Totals", all_c3: np.ndarray, all_t3: np.ndarray) -> np.ndarray:
        """Predictive probability of each pair of words under one seating."""
        d3, p2 = total.word_d, self.probabilities(state, total)
        return (self.c3 - d3 * t3 + (WORD_STRENGTH + d3 * all_t3[self.ctx]) * p2[self.up]) / (WORD_STRENGTH + all_c3[self.ctx])

    def restaurants(self, t3: np.ndarray, state: tuple) -> list[tuple]:
        """(level, key, customers, tables) of this bucket, as TOTALS."""
        t2, c1, t1, c0, t0 = state
        return _restaurants(self, t2, c1, t1, c0, t0) + [(ONCE, WORD_LEVEL, *_discount(self.c3))]


#: Levels of the totals: two bytes, one byte, words; then discount counts (key: level, WORD_LEVEL: whole words before) and corpus counts.
ONCE, CORPUS = 3, 4
WORD_LEVEL = 3
TOTALS = "level long, key long, customers long, tables long"


def _restaurants(b: Bucket, t2: np.ndarray, c1: np.ndarray, t1: np.ndarray, c0: np.ndarray, t0: np.ndarray) -> list[tuple]:
    """(level, key, customers, tables) of a bucket's suffix levels."""
    out: list[tuple] = [(CORPUS, 0, int(b.count.sum()), int((b.count > 0).sum()))]
    for level, key, c, tables in ((0, b.k2, b.c2, t2), (1, b.k1, c1, t1), (2, np.zeros(len(c0), np.int64), c0, t0)):
        cs, ts = np.bincount(key, c), np.bincount(key, tables)
        some = np.flatnonzero(cs)
        out += zip([level] * len(some), some.tolist(), cs[some].astype(int).tolist(), ts[some].astype(int).tolist())
        out.append((ONCE, level, *_discount(c)))
    return out


def _merge(t: pa.Table) -> pa.Table:
    """The rows of a bucket as one, by block."""
    t = t.sort_by("block")
    lists = {c: [t.column(c).to_pylist()] for c in ("block", "n", "data", "more")}
    types = {"block": pa.int64(), "n": pa.int32(), "data": pa.binary(), "more": pa.binary()}
    return pa.table({"bucket": t.column("bucket")[:1], **{c: pa.array(x, pa.list_(types[c])) for c, x in lists.items()}})


def _buckets(batches):
    """(rows of PAIRS, Bucket) of each bucket in turn."""
    for batch in batches:
        for k in range(batch.num_rows):
            bucket, *lists = (batch.column(c)[k].as_py() for c in ("bucket", "block", "n", "data", "more"))
            none = [b""] * len(lists[0])
            packed = {"bucket": [bucket] * len(none), "block": lists[0], "kind": [PAIRS] * len(none), "n": lists[1], "data": lists[2], "more": lists[3]}
            rows = rows_of(pa.table(packed))
            del packed, lists
            yield rows, Bucket(rows)
            trim()


def _totals(history: list):
    """Customers and tables of every restaurant in each bucket after the sweeps of ``history``; once and twice counts; tokens and distinct words."""

    def run(batches):
        for _, b in _buckets(batches):
            *_, (t2, c1, t1, c0, t0) = b.states(history)
            out = _restaurants(b, t2, c1, t1, c0, t0)
            del b
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["level", "key", "customers", "tables"])

    return run


class Totals:
    """Restaurant totals of all buckets after a sweep, from at most 65,797 rows (level, key, customers, tables)."""

    def __init__(self, level: np.ndarray, key: np.ndarray, customers: np.ndarray, tables: np.ndarray):
        size = (1 << 16, 256, 1)
        self.c, self.t = [np.zeros(n) for n in size], [np.zeros(n) for n in size]
        for k in range(3):
            own = level == k
            self.c[k][key[own]], self.t[k][key[own]] = customers[own], tables[own]
        once = np.flatnonzero(level == ONCE)
        self.d, self.word_d = [0.5] * 3, 0.5
        for i in once.tolist():
            rate = _rate(int(customers[i]), int(tables[i]))
            if key[i] == WORD_LEVEL:
                self.word_d = rate
            else:
                self.d[key[i]] = rate
        self.n = int(customers[level == CORPUS].sum())
        self.v = int(tables[level == CORPUS].sum())


def _answers(history: list):
    """Per block: log10 probability of each of its pairs, and the training count of each of its words."""

    def run(batches):
        for rows, b in _buckets(batches):
            p = np.zeros(len(b.word))
            for k, state in enumerate(b.states(history[:-1])):
                if k > BURN_IN:
                    p += b.probabilities(state, history[k])
            log = np.log10(p / SAMPLES).astype(np.float32)[b.pair_of]
            count = b.count.astype(np.uint64)[b.word_of]
            sizes = b.sizes
            del b, p
            out, w, q = [], 0, 0
            for (block, n, m), (_, _, _, _, data, _) in zip(sizes, rows):
                per_word = get(data, np.uint32, n, 8 * n)
                out.append((rows[0][0], block, ANSWER, m, log[q : q + m].tobytes(), put(np.repeat(count[w : w + n], per_word))))
                w, q = w + n, q + m
            yield emit(out)

    return run


def _state(bucket: int, b: Words, t3: np.ndarray, state: tuple, homes: int, with_customers: bool) -> list[tuple]:
    """Rows of a seating: its tables; its contexts' tables (at first, customers too) for their homes; its suffix restaurants."""
    t2, _, t1, _, t0 = state
    u32 = lambda a: put(a.astype(np.uint32))
    rows = [(bucket, 0, STATE, len(t3), u32(t3), u32(t2) + u32(t1) + put(t0.astype(np.uint64)))]
    tables = np.bincount(b.ctx, t3, minlength=len(b.contexts)).astype(np.uint32)
    customers = np.bincount(b.ctx, b.c3, minlength=len(b.contexts)).astype(np.uint64)
    home = _home_of(b.contexts, homes)
    order = np.argsort(home, kind="stable")
    present, cuts = np.unique(home[order], return_index=True)
    for h, at in zip(present.tolist(), np.split(order, cuts[1:])):
        rows.append((h, bucket, TABLES, len(at), put_sorted(b.contexts[at]), put(tables[at]) + (put(customers[at]) if with_customers else b"")))
    totals = np.array(b.restaurants(t3, state), np.int64)
    return [*rows, (bucket, 0, TOTAL, len(totals), put(totals.T.ravel().view(np.uint64)), b"")]


def _home_of(contexts: np.ndarray, homes: int) -> np.ndarray:
    return ((contexts & np.uint64(0xFFFFFFFF)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)


def _build(book: np.ndarray, homes: int):
    """A bucket's rows of PAIRS -> its structure, each block's places in it, and the first seating."""

    def run(t: pa.Table) -> pa.Table:
        rows = rows_of(t.sort_by("block"))
        bucket = rows[0][0]
        b, blocks = Words.gathered(rows, book)
        n, data, more = b.packed()
        out = [(bucket, 0, STRUCTURE, n, data, more)]
        out += [(bucket, block, INDEX, len(x), put_sorted(x), b"") for block, x in blocks]
        out += _state(bucket, b, *b.first(), homes, True)
        del rows, b, blocks
        trim()
        return pa.Table.from_batches([emit(out)])

    return run


def _home(t: pa.Table) -> pa.Table:
    """Rows of TABLES of some contexts from all buckets -> their sums, in the order in which each bucket named them."""
    rows = rows_of(t)
    found, of = np.unique(np.concatenate([get_sorted(r[4], np.uint64, r[3]) for r in rows]), return_inverse=True)

    def total(dtype, at):
        own = np.concatenate([get(r[5], dtype, r[3], at * r[3]) for r in rows])
        return np.bincount(of, own, minlength=len(found)).astype(np.uint64)[of]

    cuts = np.cumsum([r[3] for r in rows])[:-1]
    tables = np.split(total(np.uint32, 0), cuts)
    customers = np.split(total(np.uint64, 4), cuts) if len(rows[0][5]) > 4 * rows[0][3] else [None] * len(rows)
    return pa.Table.from_batches([
        emit([(r[1], r[0], REPLY, r[3], put(x), b"" if c is None else put(c)) for r, x, c in zip(rows, tables, customers)])
    ])


def _opened(t: pa.Table, homes: int):
    """A bucket's rows -> its number; its pairs; tables of each sweep; customers of its contexts in all buckets; their tables after each sweep; its INDEX rows."""
    numbers = t.column("sweep").to_pylist()
    rows = rows_of(t)
    (b,) = (Words.unpacked(*r[3:]) for r in rows if r[2] == STRUCTURE)
    n2, n1, n0 = len(b.word), len(b.mid_word), len(b.hashes)
    seats, all_t3, all_c3 = {}, {}, np.zeros(len(b.contexts))
    order = np.argsort(_home_of(b.contexts, homes), kind="stable")
    i64 = lambda raw, dtype, n, at=0: get(raw, dtype, n, at).astype(np.int64)
    for k in sorted(set(numbers)):
        own = [r for number, r in zip(numbers, rows) if number == k]
        for _, _, kind, n, data, more in own:
            if kind == STATE:
                seats[k] = (i64(data, np.uint32, n), i64(more, np.uint32, n2), i64(more, np.uint32, n1, 4 * n2), i64(more, np.uint64, n0, 4 * (n2 + n1)))
        replies = sorted((r for r in own if r[2] == REPLY), key=lambda r: r[1])
        if replies:
            all_t3[k] = np.empty(len(order))
            all_t3[k][order] = np.concatenate([get(r[4], np.uint64, r[3]) for r in replies])
            if k == 0:
                all_c3[order] = np.concatenate([get(r[5], np.uint64, r[3]) for r in replies])
    return rows[0][0], b, seats, all_c3, all_t3, [r for r in rows if r[2] == INDEX]


def _sweep(number: int, total: Totals, homes: int):
    """A bucket's structure, last seating and its contexts' totals -> its next seating."""

    def run(t: pa.Table) -> pa.Table:
        bucket, b, seats, _, all_t3, _ = _opened(t, homes)
        t3, state = b.seated(*seats[number])
        out = _state(bucket, b, *b.sweep(t3, state, total, all_t3[number], number), homes, False)
        del b, seats, all_t3
        trim()
        return pa.Table.from_batches([emit(out)])

    return run


def _word_answers(history: list, homes: int):
    """As ``_answers``, from a bucket's structure, sampled seatings and blocks."""

    def run(t: pa.Table) -> pa.Table:
        bucket, b, seats, all_c3, all_t3, blocks = _opened(t, homes)
        p = np.zeros(len(b.c3))
        for k, tables in seats.items():
            t3, state = b.seated(*tables)
            p += b.word_probabilities(t3, state, history[k], all_c3, all_t3[k])
        log, count = np.log10(p / SAMPLES).astype(np.float32), b.count.astype(np.uint64)[b.word3]
        del b, seats, all_c3, all_t3, p
        out = []
        for _, block, _, n, data, _ in blocks:
            at = get_sorted(data, np.uint32, n)
            out.append((bucket, block, ANSWER, n, log[at].tobytes(), put(count[at])))
        trim()
        return pa.Table.from_batches([emit(out)])

    return run


def _unpacked_totals(batches):
    for batch in batches:
        for _, _, _, n, data, _ in rows_of(pa.Table.from_batches([batch])):
            columns = get(data, np.uint64, 4 * n).view(np.int64).reshape(4, n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["level", "key", "customers", "tables"])


def _summed(found: DataFrame) -> Totals:
    """TOTALS over all buckets; at most one row for each suffix restaurant."""
    found = found.groupBy("level", "key").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).toArrow()
    return Totals(*(found.column(c).to_numpy() for c in ("level", "key", "customers", "tables")))


def _contexts(batches):
    """Names of contexts in some texts, and their numbers."""
    for texts, _, _ in _blocks(batches):
        _, names, _, before, _ = tokens(texts)
        n = np.bincount(before, minlength=len(names))
        top = np.argsort(-n, kind="stable")[:BOOK]
        yield pa.RecordBatch.from_arrays([pa.array(names[top].astype(np.int64)), pa.array(n[top])], names=["name", "n"])


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Within, a finished job's shuffle files are deleted: all its steps are written, none is read from a shuffle again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _of(df: DataFrame, *kinds: int) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def _whole_answers(d: DataFrame, buckets: int, n_docs: int) -> tuple[DataFrame, DataFrame, Totals]:
    """(rows of places and documents, rows of ANSWER, totals) with whole words as contexts. Tables are deleted once nothing reads them."""
    some = d.where(F.expr(f"pmod(xxhash64(doc_id, text), {max(1, n_docs // SAMPLE)})") == 0)
    top = some.mapInArrow(_contexts, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    book = np.sort(top.orderBy(F.desc("n"), "name").limit(BOOK).toArrow().column("name").to_numpy().astype(np.uint64))
    homes = buckets // 4 + 1
    # pairs in a folder of their own, so that it can be deleted
    path = new_path(d.sparkSession, "counts")
    d.mapInArrow(_gather(buckets, book), ROW).withColumn("pairs", F.col("kind") == PAIRS).write.partitionBy("pairs").parquet(path)
    packed = d.sparkSession.read.schema(f"{ROW}, pairs boolean").parquet(path)
    pairs, rest = packed.where("pairs").drop("pairs"), packed.where("not pairs").drop("pairs")
    built = written(pairs.groupBy("bucket").applyInArrow(_build(book, homes), ROW), "counts")
    deleted(d.sparkSession, f"{path}/pairs=true")
    structure = _of(built, STRUCTURE).withColumn("sweep", F.lit(-1))
    history: list[Totals] = []
    seatings: list[DataFrame] = [built]
    replies: list[DataFrame] = []
    for number in range(BURN_IN + SAMPLES + 1):
        last = seatings[number]
        history.append(_summed(_of(last, TOTAL).mapInArrow(_unpacked_totals, TOTALS)))
        replies.append(written(_of(last, TABLES).groupBy("bucket").applyInArrow(_home, ROW), "counts"))
        if number < BURN_IN + SAMPLES:
            rows = structure
            for df in (_of(last, STATE), replies[number]):
                rows = rows.unionByName(df.withColumn("sweep", F.lit(number)))
            seatings.append(written(rows.groupBy("bucket").applyInArrow(_sweep(number, history[-1], homes), ROW), "counts"))
            if 0 < number <= BURN_IN:
                dropped(last, replies[number])
    rows = structure.unionByName(_of(built, INDEX).withColumn("sweep", F.lit(-1))).unionByName(replies[0].withColumn("sweep", F.lit(0)))
    for number in range(BURN_IN + 1, BURN_IN + SAMPLES + 1):
        for df in (_of(seatings[number], STATE), replies[number]):
            rows = rows.unionByName(df.withColumn("sweep", F.lit(number)))
    answers = written(rows.groupBy("bucket").applyInArrow(_word_answers(history, homes), ROW), "counts")
    dropped(built, replies[0], *seatings[BURN_IN + 1 :], *replies[BURN_IN + 1 :])
    return rest, answers, history[-1]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sums(n_train: int, v_train: int):
    """A block's places and answers -> its documents' scores."""

    def run(t: pa.Table) -> pa.Table:
        rows = rows_of(t)
        _, _, _, n, data, more = next(r for r in rows if r[2] == DOCS)
        ids, n_tokens = np.frombuffer(data, np.int64, n), get(data, np.uint32, n, 8 * n).astype(np.int64)
        missing, train = np.frombuffer(more, bool).reshape(2, n)
        answers = {r[0]: r for r in rows if r[2] == ANSWER}
        known, base, score = np.zeros(n), np.zeros(n), np.zeros(n)
        for bucket, _, _, m, counts, docs in (r for r in rows if r[2] == PLACES):
            per = get(counts, np.uint32, m).astype(np.int64)
            doc = get(docs, np.uint32, int(per.sum())).astype(np.int64)
            _, _, _, _, log, c = answers[bucket]
            c = get(c, np.uint64, m).astype(float)
            own = np.log10((c + 0.5) / (n_train + 0.5 * (v_train + 1)))
            score += np.bincount(doc, np.repeat(np.frombuffer(log, np.float32, m).astype(float), per), minlength=n)
            base += np.bincount(doc, np.repeat(own, per), minlength=n)
            known += np.bincount(doc, np.repeat(c > 0, per), minlength=n)
        return pa.table({
            "doc_id": pa.array(ids, mask=missing), "held_out": pa.array(~train), "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(n, n_train, np.int64)),
            "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = HELD_OUT, whole_words: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A token's context is the word before; only its last two bytes, a coarser and cheaper model, without ``whole_words``.
    The model learns from every row whose fold is not ``held_out``. A null or
    empty text is its end token alone. Rows that repeat an id, and null ids,
    are documents of their own. An empty table gives an empty result. The
    perplexity of a set of rows is 10 ** (-sum(score) / sum(n_tokens)).
    """
    d = docs.select(
        F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"),
        (fold_of(F.col(id_col)) != held_out).alias("train"),
    )
    size, n_docs = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = int(size // BUCKET_BYTES) + 1
    arrow_rows(docs.sparkSession)
    if whole_words:
        with _shuffles_dropped(docs.sparkSession):
            rest, answers, total = _whole_answers(d, buckets, n_docs)
        return rest.unionByName(answers).groupBy("block").applyInArrow(_sums(total.n, total.v), SCORES)
    packed = written(d.mapInArrow(_gather(buckets), ROW), "counts")
    pairs = packed.where(F.col("kind") == PAIRS)
    merged = written(pairs.groupBy("bucket").applyInArrow(_merge, MERGED), "counts")
    history: list[Totals] = []  # before each sweep and after the last
    for _ in range(BURN_IN + SAMPLES + 1):
        history.append(_summed(merged.mapInArrow(_totals(history), TOTALS)))
    answers = merged.mapInArrow(_answers(history), ROW)
    both = packed.where(F.col("kind") != PAIRS).unionByName(answers)
    return both.groupBy("block").applyInArrow(_sums(history[-1].n, history[-1].v), SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) over the rows of ``score``."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
