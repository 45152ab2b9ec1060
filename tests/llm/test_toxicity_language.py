import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmalake.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"  # enough labels to learn from
ODD = [(70_000, None), (70_001, ""), (70_002, " \n"), (70_003, "... 123"), (70_003, "... 123"), (None, "the idiot"), (70_004, "word " * 60_000), (70_005, "É ü ß")]


def test_toxicity_on_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r, labels[r.doc_id]) for r in queries.QUERIES["op6_toxicity"](spark, SF).collect() if r.doc_id in labels and r.held_out]
    assert len(got) > 50 and np.mean([r.predicted == y for r, y in got]) > 0.93
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r, _ in got)
    clean = [r for r, y in got if y == 0]
    assert np.mean([r.predicted for r in clean]) < 0.03


def test_toxicity_of_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs.withColumn("y", F.lit(1)), labels)
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows if r.predicted} == {None}
    assert len({r.score for r in rows if r.doc_id in (70_000, 70_001, 70_002, 70_003)}) == 1
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert toxicity.score(odd.limit(0), model).count() == 0
    # no labels, or labels of one kind: one score for all
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert not one.weights and 0 <= one.score(b"idiot") < 0.5
    assert not toxicity.train(docs.limit(0), labels.limit(0)).weights
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert again.weights == model.weights and again.bias == model.bias


def test_counterfactual_penalty_takes_weight_from_identity_terms():
    """Toxic texts often name a group; with the penalty, naming it alone hardly moves the score."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(600):
        toxic = k % 3 == 0
        text = rng.sample(words, 8)
        if toxic:
            text.append("idiot" if rng.random() < 0.8 else "filler")
        if rng.random() < (0.9 if toxic else 0.1):
            text.append("muslim")
        own = {w.encode() for w in text}
        x, y = toxicity.features(own), toxicity.features(toxicity.counterfactual(own))
        pack = lambda s: np.array(sorted(s), "<u4").tobytes()
        rows.append((pack(x), pack(y - x), pack(x - y), int(toxic)))
    free, fair = toxicity.fit(rows, fairness=0.0), toxicity.fit(rows, fairness=toxicity.FAIRNESS * 25)
    gap = lambda m: m.score(b"w1 w2 w3 muslim") - m.score(b"w1 w2 w3 christian")
    assert abs(gap(fair)) < 0.5 * abs(gap(free))
    assert fair.score(b"w1 w2 idiot muslim") > fair.score(b"w1 w2 muslim")
    assert toxicity.counterfactual({b"old", b"x"}) == {b"young", b"x"}


def test_language_on_held_out_documents(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_language"](spark, SF).collect()
    assert len(rows) == len(want)
    assert np.mean([want[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_spans_scripts_and_odd_rows(spark):
    train = [(k, t, lang) for k in range(60) for t, lang in (("the cat and the dog of this house", "en"), ("der hund und die katze in dem haus", "de"), ("кошка и собака в этом доме", "ru"))]
    model = language.train(spark.createDataFrame([(3 * k + j, t, l) for j, (k, t, l) in enumerate(train)], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    mixed = "the cat of this house and the dog " * 6 + "der hund in dem haus und die katze " * 4 + "кошка в доме"
    rows = [*ODD, (80_000, mixed), (80_001, "кошка"), (80_002, "日本語"), (80_003, "… —")]
    got = {}
    for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(0)), model, with_spans=True).collect():
        got[r.doc_id] = r
    for i in (70_000, 70_001, 70_002, 70_003, 80_003):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    spans = [(s.first, s.words, s.lang) for s in got[80_000].spans]
    assert spans == [(0, 48, "en"), (48, 32, "de"), (80, 3, "ru")] and got[80_000].lang_pred == "en" and got[80_000].score < 0.7
    assert got[80_001].lang_pred == "ru" and got[80_002].lang_pred in model.langs
    assert language.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    none = language.train(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    assert none.langs == [] and language.identify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).first().lang_pred == "und"


def test_rare_languages_are_learned_and_samples_bounded(spark):
    rows = [(k, "xx" if k % 4000 == 1 else "en" if k % 3 else "de") for k in range(12_000)]
    docs = spark.createDataFrame(rows, "i long, l string")
    got = language.chosen(docs, 300).groupBy("l").count().collect()
    assert {r.l: r["count"] for r in got} == {"xx": 3, "en": 100, "de": 100}
    assert sorted(language.chosen(docs, 300).collect()) == sorted(language.chosen(docs.repartition(5), 300).collect())
    assert language.chosen(docs.limit(0), 300).count() == 0


def test_language_against_a_plain_version(spark):
    """Counts, word scores, script narrowing and the choice of a text's language, a gram and a path at a time."""
    import re

    train = [("the cat sat on the mat", "en"), ("the dog and the house", "en"), ("der hund sitzt im haus", "de"), ("die katze und der hund", "de"), ("кошка и собака", "ru")]
    docs = [(5 * k + j, t, lang) for k in range(30) for j, (t, lang) in enumerate(train)]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    from zlib import crc32

    learned = [(t, lang) for i, t, lang in docs if crc32(str(i).encode()) % 5]
    langs = ["de", "en", "ru"]

    def hashed(text, n):
        out = []
        for at in range(len(text) - n + 1):
            h = 0
            for byte in text[at : at + n]:
                h = (h * 16777619 ^ byte) % 2**32
            out.append((h * 2654435761 % 2**32) >> 16)
        return out

    def own(word, n):  # a word's grams: with the blanks around it, single bytes without
        return hashed(word if n == 1 else b" " + word + b" ", n)

    counts = {(lang, n): np.full(1 << 16, 0.5) for lang in langs for n in language.ORDERS}
    for t, lang in learned:
        line = b" " + t.encode() + b" "
        for n in language.ORDERS:
            # every place once that lies in some word's reach
            places = set()
            for m in re.finditer(rb"\S+", line):
                a, b = (m.start(), m.end()) if n == 1 else (m.start() - 1, m.end() + 1)
                places |= set(range(a, b - n + 1))
            for h in (hashed(line[p : p + n], n)[0] for p in places):
                counts[lang, n][h] += 1
    log = {k: language.SCALE * np.log(c / c.sum()) for k, c in counts.items()}

    def word_scores(w):
        s = np.array([sum(log[lang, n][h] for n in language.ORDERS for h in own(w, n)) for lang in langs])
        s = s - np.where([(lang == "ru") != (not w.isascii()) for lang in langs], 1e4, 0)
        return s - s.max()

    def best(words):
        import itertools

        paths = itertools.product(range(3), repeat=len(words))
        value = lambda p: sum(word_scores(w)[k] for w, k in zip(words, p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        return max(paths, key=value)

    texts = ["the mat", "hund im haus und katze", "cat собака кошка", "house haus", "и", "xyz qqq the the the"]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = t.encode().split()
        share = np.zeros(3)
        for w, k in zip(words, best(words)):
            share[k] += len(w)
        assert got[i].lang_pred == langs[int(share.argmax())] and got[i].score == pytest.approx(share.max() / share.sum())


def test_toxicity_scores_against_a_plain_version(spark):
    from zlib import crc32

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs.where("doc_id % 20 = 0"), model).join(docs.withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).collect():
        line = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in (r.text or "").encode())
        z, seen = model.bias, set()
        for w in {x.encode("latin-1") for x in line.split(" ") if x}:
            for f in [b"w" + w] + ([b"4" + w[:4], b"5" + w[:5]] if len(w) >= 5 else []):
                seen.add(crc32(f) % toxicity.BUCKETS)
        z += sum(model.weights.get(x, 0.0) for x in seen)
        assert r.score == pytest.approx(1 / (1 + np.exp(-max(-60, min(60, z)))))
        assert r.predicted == (r.score >= 0.5)


@pytest.mark.parametrize("switch", [0.0, 2.0, 12.0])
def test_viterbi_is_the_best_path(switch):
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(30, 3)) * 3
    sizes = np.array([0, 7, 1, 5, 0, 7])
    code = rng.integers(0, 30, sizes.sum())
    label = language.viterbi(scores, code, sizes, switch)
    at = 0
    for n in sizes:
        own, path = scores[code[at : at + n]], label[at : at + n]
        at += n
        if not n:
            continue
        value = lambda p: sum(own[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = {k: own[0, k] for k in range(3)}
        for i in range(1, n):
            best = {k: own[i, k] + max(v - switch * (j != k) for j, v in best.items()) for k in range(3)}
        assert value(path.tolist()) == pytest.approx(max(best.values()))


def test_languages_are_learned_where_an_id_has_most_rows(spark):
    clean = [(k, f"wort{k % 40} haus baum und nicht" if k % 2 else f"word{k % 40} house tree and not", "de" if k % 2 else "en") for k in range(4_000)]
    docs = spark.createDataFrame(clean, "doc_id long, text string, lang string")
    hot = next(k for k in range(1, 100_000, 2) if __import__("zlib").crc32(str(k).encode()) % 5)
    many = spark.range(30_000).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit("haus baum "), "id").alias("text"), F.lit("de").alias("lang"))
    ids = docs.union(many).select(F.col("doc_id").alias("i"), F.col("lang").alias("l"))
    picked = language.chosen(ids, 1_000).collect()
    assert len(picked) == len({(r.i, r.l) for r in picked}) and 800 <= len(picked) <= 1_000
    assert min(sum(r.l == x for r in picked) for x in ("de", "en")) >= 350
    model = language.train(docs.union(many), sample=1_000)
    got = language.identify(spark.createDataFrame([(1, "baum und haus"), (2, "tree and house")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "de", 2: "en"}
    assert (language.train(docs.union(many).repartition(3), sample=1_000).log == model.log).all()  # whatever the order
