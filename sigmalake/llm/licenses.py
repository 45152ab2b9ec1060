"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

Blocks are overlapping windows of words. Templates of up to n words are compared
with windows of 2n or more that start every n or more, so that any n words in a
row lie whole in one of them, whatever the template's length. The tokens of the
templates are ordered by how many documents hold them, rarest first, counted
over all documents. A template whose containment in a block reaches the
threshold shares a token of its prefix with it; of the blocks that do, the
length and position filters drop those that cannot reach the overlap, and the
rest is counted exactly. A match must hold the template's own phrase, and gives
way to one of a template that has all its tokens and more. The templates are a
bounded, fixed list; the texts never move.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table
from .license_texts import TEMPLATES

THRESHOLD = 0.8
#: Words of the shortest blocks; longer templates have blocks of twice, four times, ... that.
BLOCK = 16

#: phrase -> label
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def phrase_places(words: list[bytes], folded: bytes, phrases: dict[str, str]) -> tuple[list[int], set[str]]:
    """Starts of all phrases, and the labels found."""
    at, labels = [], set()
    for phrase, label in phrases.items():
        want = phrase.encode().split()
        if want[-1] not in folded:
            continue
        i = -1
        while True:
            try:
                i = words.index(want[0], i + 1)
            except ValueError:
                break
            if words[i : i + len(want)] == want:
                at.append(i)
                labels.add(label)
    return at, labels


def _count_tokens(vocabulary: frozenset):
    def run(batches):
        for b in batches:
            n: dict[bytes, int] = {}
            for t in b.column(0).cast(pa.binary()):
                for w in vocabulary.intersection(words_of(t.as_py() or b"")):
                    n[w] = n.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    return run


def token_order(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """Rank of each template token by the number of documents that hold it, rarest first, ties by the token."""
    vocabulary = frozenset(w for _, _, t in templates for w in words_of(t.encode()))
    seen = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_tokens(vocabulary), "token string, n long")
    n = {r.token.encode(): r.n for r in seen.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # one row per template token
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def together(words: list[bytes], telling: frozenset) -> bool:
    """Whether all of ``telling`` stand close together in ``words``, in whatever order: within half as many words more."""
    span = len(telling) + len(telling) // 2
    return any(telling.issubset(words[i : i + span]) for i, w in enumerate(words) if w in telling) if telling else True


def block_of(n: int) -> int:
    """Words of the blocks that templates of ``n`` words are compared with."""
    size = BLOCK
    while size < 2 * n:
        size *= 2
    return size


class Join:
    """Templates (label, telling words, text), indexed by block size and by the rarest tokens of each.

    The join finds every block and template with a containment at the threshold.
    A match labels its document if the block has the template's telling words
    close together, in whatever order, and gives way to one of a template with all its tokens.
    """

    def __init__(self, order: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        self.order = order
        self.templates = []
        self.index: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for label, telling, text in templates:
            words = words_of(text.encode())
            if not words:
                raise ValueError(f"a template of {label} has no words")
            tokens = sorted(set(words), key=order.__getitem__)
            least = max(1, math.ceil(threshold * len(tokens) - 1e-9))
            index = self.index.setdefault(block_of(len(words)), {})
            for place in range(len(tokens) - least + 1):
                index.setdefault(tokens[place], []).append((len(self.templates), place))
            self.templates.append((label, tokens, frozenset(tokens), least, frozenset(words_of(telling.encode()))))
        self.prefixes = frozenset(w for index in self.index.values() for w in index)
        # the templates that have all tokens of one, and more
        self.wider = [frozenset(j for j, y in enumerate(self.templates) if x[2] < y[2]) for x in self.templates]

    def matches(self, words: list[bytes]) -> tuple[dict[int, float], dict[int, float]]:
        """Template -> its largest containment in a block of ``words``: for all that reach the threshold, and for those that label."""
        best: dict[int, float] = {}
        label: dict[int, float] = {}
        if self.prefixes.isdisjoint(words):
            return best, label
        for size, index in self.index.items():
            step = size // 2
            last = max(0, -(-(len(words) - size) // step))  # the block that reaches the end
            hit = {k for i, w in enumerate(words) if w in index for k in (i // step - 1, i // step) if 0 <= k <= last}
            for k in sorted(hit):
                block = words[k * step : k * step + size]
                found = self._block(block, index)
                telling = {t for t in found if together(block, self.templates[t][4])}
                for t, c in found.items():
                    best[t] = max(best.get(t, 0.0), c)
                    if t in telling and self.wider[t].isdisjoint(telling):
                        label[t] = max(label.get(t, 0.0), c)
        return best, label

    def _block(self, block: list[bytes], index: dict) -> dict[int, float]:
        known = sorted(self.order.keys() & set(block), key=self.order.__getitem__)
        found, tried, have = {}, set(), frozenset(known)
        for rank, w in enumerate(known):
            for t, place in index.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)
                _, tokens, whole, least, _ = self.templates[t]
                # length: the block must hold enough tokens; position: enough must come from here on, as this is the first shared
                if len(known) < least or min(len(tokens) - place, len(known) - rank) < least:
                    continue
                overlap = len(whole & have)
                if overlap >= least:
                    found[t] = overlap / len(tokens)
        return found


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "templates array<struct<template:int,label:string,containment:double>>"
)


def _scan(join: Join, phrases: dict[str, str]):
    first = frozenset(p.encode().split()[0] for p in phrases)

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).cast(pa.binary()):
                text = (t.as_py() or b"").translate(FOLD)
                words = text.split()
                at, base = phrase_places(words, text, phrases) if not first.isdisjoint(words) else ([], set())
                every, found = join.matches(words)
                labels = base | {join.templates[k][0] for k in found}
                rows = [{"template": k, "label": join.templates[k][0], "containment": c} for k, c in sorted(every.items())]
                score = max(found.values(), default=1.0 if base else 0.0)
                ends = (min(at), max(at)) if at else (None, None)
                out.append((len(words), len(at), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, rows))
            kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), types)] if out else [pa.array([], k) for k in types]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *names])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=None,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates.

    ``n_base`` counts all phrase places; first_word and last_word are null
    without any. Labels are sorted, comma-joined and empty if there are none;
    ``templates`` has every template that some block contains to ``threshold`` or
    more, with its largest containment; ``labels`` adds those of them whose
    telling words the block has too. ``score`` is the largest containment of
    these, 1 if only phrases were found, else 0. Null and empty texts have no
    words. Repeated rows and null ids give a row each; an empty table gives none.
    """
    arrow_rows(docs.sparkSession)
    join = Join(token_order(docs, templates, text_col), templates, threshold)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_scan(join, phrases or PHRASES), "doc_id long, " + SCHEMA)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    listed = F.transform("templates", lambda t: F.concat_ws(":", t["template"], t["label"], F.round(t["containment"], 4)))
    return found.withColumn("templates", F.array_join(listed, ","))
