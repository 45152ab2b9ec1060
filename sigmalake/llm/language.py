"""Language identification: script ranges, per-word scores, and Viterbi spans.

Each word is scored for every learned language by its byte n-grams with word
boundaries; languages that are not written in the word's script are out. The
best path through a text, with a penalty for every switch, labels spans of one
language; the language with the most letters is the text's. The n-gram counts
come from at most ``SAMPLE`` labelled rows; texts are labelled in one pass
without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, dropped, fold_of, small, table, trim, written

#: Most labelled rows that the counts are taken from, dealt evenly over the languages.
SAMPLE = 8_000
COUNTING_TASKS = 8
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Part of a word's log likelihood that counts, and the cost of a switch.
SCALE = 0.5
SWITCH = 12.0
UNKNOWN = "und"
BLOCK_WORDS = 1_500_000

#: Script ranges of code points; what is in none of them is of no script of its own.
SCRIPTS = (
    ("latin", r"A-Za-zªºÀ-ɏḀ-ỿⱠ-Ɀ꜠-ꟿ"),
    ("greek", r"Ͱ-Ͽἀ-῿"),
    ("cyrillic", r"Ѐ-ԯᲀ-᲏ⷠ-ⷿꙀ-ꚟ"),
    ("armenian", r"԰-֏"),
    ("hebrew", r"֐-׿"),
    ("arabic", r"؀-ۿݐ-ݿࢠ-ࣿ"),
    ("devanagari", r"ऀ-ॿ"),
    ("bengali", r"ঀ-৿"),
    ("tamil", r"஀-௿"),
    ("thai", r"฀-๿"),
    ("georgian", r"Ⴀ-ჿ"),
    ("hangul", r"ᄀ-ᇿ가-힯"),
    ("kana", r"぀-ヿ"),
    ("han", r"㐀-䶿一-鿿"),
)
_SCRIPT = [re.compile(f"[{r}]") for _, r in SCRIPTS]

#: Lower-cased ASCII letters and all bytes beyond ASCII make words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def script_of(word: bytes) -> int:
    """Number of the first script in SCRIPTS with a letter in ``word``; -1: none."""
    if word.isascii():
        return 0
    text = word.decode("utf-8", "replace")
    return next((k for k, r in enumerate(_SCRIPT) if r.search(text)), -1)


def grams(words: list[bytes]):
    """Per order: hashed n-grams at every place of ' w1 w2 ', and for each word the first place and the place after its last one."""
    line = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1)  # place of the blank after each word
    start = stop - size - 1  # and of the blank before it
    h = np.zeros(len(line), np.uint32)
    for n in ORDERS:
        h = h[: len(line) - n + 1] * np.uint32(16777619) ^ line[n - 1 :]
        mixed = h * np.uint32(2654435761)
        first = start + (n == 1)
        last = stop + (n > 1) - n + (n == 1)
        yield (mixed >> np.uint32(16)).astype(np.int64), first, np.maximum(last, first)


def _counts(langs: list[str]):
    def run(batches):
        total = np.zeros((len(langs), len(ORDERS), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), np.int64)
        place = {x: k for k, x in enumerate(langs)}
        for b in batches:
            for t, lang in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist()):
                words = (t.as_py() or b"").translate(LETTERS).split()
                if not words:
                    continue
                k = place[lang]
                for o, (h, first, last) in enumerate(grams(words)):
                    edge = np.zeros(len(h) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last, -1)
                    total[k, o] += np.bincount(h[np.cumsum(edge[:-1]) > 0], minlength=BUCKETS)
                for w in set(words):
                    s = script_of(w)
                    if s >= 0:
                        scripts[k, s] += 1
        for k, lang in enumerate(langs):
            if total[k].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([total[k].astype("<i8").tobytes()]), pa.array([scripts[k].astype("<i8").tobytes()])],
                    names=["lang", "grams", "scripts"],
                )

    return run


def _summed(t: pa.Table) -> pa.Table:
    """The counts of one language from several tasks as one row."""
    add = lambda c: sum(np.frombuffer(x, "<i8") for x in t.column(c).to_pylist()).astype("<i8").tobytes()
    return pa.table({"lang": t.column("lang").slice(0, 1), "grams": [add("grams")], "scripts": [add("scripts")]})


class Model:
    """Languages, log probabilities (order, bucket, language), and which language is written in which script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        c = counts.astype(float) + SMOOTHING
        self.log = np.ascontiguousarray(np.moveaxis(np.log(c / c.sum(axis=2, keepdims=True)), 0, 2)) * SCALE if langs else None
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = share > 0.01 if langs else None

    def words(self, words: list[bytes]) -> np.ndarray:
        """(word, language) scores."""
        out = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(words), 60_000):
            some = words[at : at + 60_000]
            for o, (h, first, last) in enumerate(grams(some)):
                up = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.log[o][h], axis=0)])
                out[at : at + len(some)] += up[last] - up[first]
        script = np.fromiter(map(script_of, words), np.int64, len(words))
        for s in np.unique(script[script >= 0]):
            if self.allowed[:, s].any():  # a script that no language is written in narrows nothing
                out[np.ix_(script == s, ~self.allowed[:, s])] -= 1e4
        out -= out.max(axis=1, keepdims=True)
        out[script < 0] = 0  # no letter of any script: says nothing
        return out


def viterbi(scores: np.ndarray, code: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word of several texts (``code``: rows of ``scores``, text after text), all texts a step at a time."""
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    k = scores.shape[1]
    label = np.zeros(len(code), np.int16)
    came = np.zeros((len(code), k), bool)  # a switch led here, from the best language of the word before
    best = np.zeros(len(code), np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left") if longest else []
    value = np.zeros((len(sizes), k))
    for t in range(longest):
        at = begin[: active[t]] + t
        v = value[: len(at)]
        if t:
            top = v.max(axis=1, keepdims=True) - switch
            came[at] = v < top
            np.maximum(v, top, out=v)
        v += scores[code[at]]
        best[at] = v.argmax(axis=1)
        value = v if len(v) == len(value) else _kept(value, v)
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        ended = active[t + 1] if t + 1 < longest else 0
        if ended < len(at):
            label[at[ended:]] = best[at[ended:]]
        if ended:
            nxt = label[at[:ended] + 1]
            label[at[:ended]] = np.where(came[at[:ended] + 1, nxt], best[at[:ended]], nxt)
    return label


def _kept(value: np.ndarray, v: np.ndarray) -> np.ndarray:
    value[: len(v)] = v
    return value


def _spans(label: np.ndarray, sizes: np.ndarray):
    """(first word, words, language) of each span, and the text it is in."""
    if not len(label):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    text = np.repeat(np.arange(len(sizes)), sizes)
    new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (text[1:] != text[:-1])])
    return new, np.diff(np.r_[new, len(label)]), label[new].astype(np.int64), text[new]


def _label(model: Model, switch: float, with_spans: bool):
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            at = 0
            while at < len(texts):
                split, n, first = [], 0, at
                while at < len(texts) and n < BLOCK_WORDS:
                    split.append((texts[at].as_py() or b"").translate(LETTERS).split())
                    n += len(split[-1])
                    at += 1
                yield _answer(model, switch, with_spans, b.column(0).slice(first, at - first), texts[first:at], split)

    return run


def _answer(model, switch, with_spans, ids, texts, split):
    sizes = np.array([len(w) for w in split], np.int64)
    known: dict[bytes, int] = {}
    for words in split:
        known.update(dict.fromkeys(words))
    for k, w in enumerate(known):
        known[w] = k
    lang, score = [UNKNOWN] * len(split), np.zeros(len(split))
    spans: list[list] = [[] for _ in split]
    if known and model.langs:
        code = np.fromiter((known[w] for words in split for w in words), np.int64, int(sizes.sum()))
        label = viterbi(model.words(list(known)), code, sizes, switch)
        letters = np.fromiter(map(len, known), np.int64, len(known))[code]
        text = np.repeat(np.arange(len(split)), sizes)
        share = np.bincount(text * len(model.langs) + label, letters, minlength=len(split) * len(model.langs)).reshape(len(split), -1)
        top, total = share.argmax(axis=1), share.sum(axis=1)
        for i in np.flatnonzero(total > 0).tolist():
            words = split[i]
            if any(w[0] < 128 for w in words) or any(c.isalpha() for c in texts[i].as_py().decode("utf-8", "replace")):
                lang[i], score[i] = model.langs[top[i]], share[i, top[i]] / total[i]
        if with_spans:
            begin = np.cumsum(sizes) - sizes
            for a, n, k, i in zip(*(x.tolist() for x in _spans(label, sizes))):
                spans[i].append({"first": a - int(begin[i]), "words": n, "lang": model.langs[k]})
    columns, names = [ids, pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"]
    if with_spans:
        columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
        names.append("spans")
    return pa.RecordBatch.from_arrays(columns, names=names)


def chosen(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(i, l) of rows (i, l) to learn from, each once: of each language the least hashes of the id, up to an equal part of ``sample``.

    Rows beyond a hash bound, which keeps some 1.5 times as many ids, are dropped
    before anything is grouped or sorted, so no task sorts all rows of a
    language. An id that many rows repeat counts once.
    """
    count = written(docs.groupBy("l").agg(F.approx_count_distinct("i").alias("n")), "languages")  # a row for each language
    langs = count.count()
    if not langs:
        return docs.limit(0)
    quota = max(1, sample // langs)
    unit = F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / float(1 << 40)
    near = docs.join(small(count), "l").where(unit * F.col("n") <= 1.5 * quota + 50).select("i", "l").distinct()
    place = F.row_number().over(W.partitionBy("l").orderBy(unit, "i"))
    return near.select("i", "l", place.alias("place")).where(F.col("place") <= quota).select("i", "l")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """The model, from ids with a language outside fold 0, at most ``sample`` of them, an equal number of each language as far as it has them.

    Of rows that repeat an id in a language the text with the least hash is
    learned from. The sampled texts are written once, counted by several tasks,
    summed by language, and a row for each language comes to the driver.
    """
    d = docs.select(F.col(id_col).cast("long").alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    d = d.where("l is not null and t is not null").where(fold_of(F.col("i")) != 0)
    picked = written(chosen(d.select("i", "l"), sample), "sample")  # ids first: no text is sorted
    langs = sorted(r.l for r in picked.select("l").distinct().collect())  # at most ``sample`` rows
    d = d.withColumn("h", F.xxhash64("t"))
    least = d.select("i", "l", "h").join(F.broadcast(picked), ["i", "l"]).groupBy("i", "l").agg(F.min("h").alias("h"))
    least = written(least, "sample")  # no text was moved for it
    own = d.join(F.broadcast(least), ["i", "l", "h"]).dropDuplicates(["i", "l", "h"]).select("t", "l")
    own = written(own.repartition(COUNTING_TASKS), "sample")
    counts = np.zeros((len(langs), len(ORDERS), BUCKETS), np.int64)
    scripts = np.zeros((len(langs), len(SCRIPTS)), np.int64)
    counted = own.mapInArrow(_counts(langs), "lang string, grams binary, scripts binary")
    for r in counted.groupBy("lang").applyInArrow(_summed, "lang string, grams binary, scripts binary").toLocalIterator():
        counts[langs.index(r.lang)] = np.frombuffer(r.grams, "<i8").reshape(len(ORDERS), BUCKETS)
        scripts[langs.index(r.lang)] = np.frombuffer(r.scripts, "<i8")
    dropped(picked, least, own)
    model = Model(langs, counts, scripts)
    del counts
    trim()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH,
             with_spans: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score[, spans of (first word, words, language)].

    ``score`` is the part of the letters in spans of lang_pred. Texts that are
    null or have no letter are ``und`` with score 0. Repeated rows and null ids
    give a row each; an empty table gives none.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    arrow_rows(docs.sparkSession, 10_000)  # a Viterbi step takes all texts of a batch at once
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<first:long,words:long,lang:string>>" * with_spans
    return d.mapInArrow(_label(model, switch, with_spans), schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
