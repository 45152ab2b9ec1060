import random
import re

from pyspark.sql import functions as F

from sigmalake.llm import licenses
from sigmalake.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, block_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc_id, text):
    w = words_of(text)
    at, base, labels, score, every = [], set(), set(), 0.0, {}
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                base.add(label)
    size_of = {len(words_of(t)): block_of(len(words_of(t))) for _, _, t in TEMPLATES}
    for size in sorted(set(size_of.values())):
        for i in range(0, max(1, len(w) - size // 2), size // 2):
            block, found = w[i : i + size], {}
            for k, (label, telling, t) in enumerate(TEMPLATES):
                want = set(words_of(t))
                c = len(want & set(block)) / len(want)
                if size_of[len(words_of(t))] == size and c >= THRESHOLD - 1e-12:
                    every[k] = max(every.get(k, 0), c)
                    own, near = set(telling.split()), len(telling.split()) * 3 // 2
                    if any(own <= set(block[j : j + near]) for j in range(len(block))):
                        found[k] = c
            for k, c in found.items():
                if not any(set(words_of(TEMPLATES[k][2])) < set(words_of(TEMPLATES[j][2])) for j in found):
                    labels.add(TEMPLATES[k][0])
                    score = max(score, c)
    score = score or float(bool(base))
    return doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, [(k, TEMPLATES[k][0], c) for k, c in sorted(every.items())]


def test_licenses_against_brute_force(spark, sf):
    rng = random.Random(8)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(5000, None), (5001, ""), (5002, "..."), (None, "MIT License"), (5003, "MIT license mit  LICENSE"), (5003, "mit license"), (5004, "mit " * 40_000 + "license é1")]
    pool = [w for _, _, t in TEMPLATES for w in words_of(t)] + ["x", "y", "z"] * 10
    for k in range(300):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 200))]
        _, _, t = rng.choice(TEMPLATES)
        t = [x for x in words_of(t) if rng.random() < 0.9]
        at = rng.randint(0, len(w))
        odd.append((6000 + k, " ".join(w[:at] + t + w[at:])))
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("labels", F.lit(1))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(((*r[:-1], [tuple(t) for t in r[-1]]) for r in licenses.scan(docs).collect()), key=key)
    assert got == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert {"cc-by-nc", "gpl", "apache", "mit"} <= {x for r in got for x in r[6].split(",")}
    assert licenses.scan(docs.limit(0)).count() == 0


def labels_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in sorted(licenses.scan(docs).collect())]


def test_whole_texts_and_notices_have_their_own_label_only(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    texts = [f"{filler}{t} {filler}" for _, _, t in TEMPLATES]
    # the phrase "general public license" gives its base label wherever it stands
    assert labels_of(spark, texts) == [f"{label},gpl" if label == "agpl" else "gpl,lgpl" if label == "lgpl" else label for label, _, _ in TEMPLATES]
    foreign = [
        "released under the BSD license", "licensed under the Motosoto license version 2.0", "released under the FooBar license",
        "this work is licensed under the European Union public license version 3", "the licence of this text is unknown",
        "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "first licensed under CC BY-NC 4.0 then licensed under CC BY-SA 4.0",
        "Permission is hereby granted to copy this text, free of any charge, to any person",
    ]
    assert labels_of(spark, foreign) == ["bsd", "", "", "", "", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc,cc-by-sa", ""]


def test_edited_texts_are_found(spark):
    text = {label: t for label, _, t in reversed(TEMPLATES)}
    edited = [
        text["mit"].replace("hereby granted", "granted hereby"), text["apache"].replace("Apache License", "Apache-2 Licence"), text["agpl"].replace("Affero", "AFFERO", 1),
        text["bsd"].replace("source and binary", "binary and source"), "Released under the license MIT", text["epl"].replace("Eclipse Public License", "Eclipse-Public-Licence"),
    ]
    assert labels_of(spark, edited) == ["mit", "apache", "agpl,gpl", "bsd", "mit", "epl"]
    # a block at the threshold is told even where its licence is another one
    got = licenses.scan(spark.createDataFrame([(1, "released under the FooBar license")], "doc_id long, text string")).first()
    assert got.labels == "" and got.score == 0 and {t.label for t in got.templates} == {"mit", "bsd"} and {t.containment for t in got.templates} == {0.8}


def test_long_templates_have_blocks_that_hold_them(spark):
    long = " ".join(f"t{i}" for i in range(700))
    docs = spark.createDataFrame([(1, "x " * 333 + long + " y" * 500), (2, "x " * 900)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, templates=(("own", "t1 t2", long),)).collect()}
    assert got == {1: ("own", 1.0), 2: ("", 0.0)}


def test_tokens_are_ordered_by_document_frequency(spark):
    docs = spark.createDataFrame([("a b",), ("b b c",), ("c b",)], "text string")
    order = licenses.token_order(docs, (("x", "", "A b c d"),))
    assert order == {b"d": 0, b"a": 1, b"c": 2, b"b": 3}
