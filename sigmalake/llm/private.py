"""Personal data: generators of high recall propose spans, boosted trees judge them, calibrated thresholds select.

Base spans (strict e-mail, IP, card and phone formats) always count. Generators
propose much more: written-out and spaced addresses, defanged and version 6 IPs,
national phone formats, cards with any separator, account numbers, identity
numbers and secrets; their spans may overlap, also those of other kinds. Each is
described by its format and its surroundings and scored by gradient-boosted
trees. Per kind a threshold is set where, on examples that the trees have not
seen, the calibrated (isotonic) precision reaches PRECISION. Of the spans over
their threshold the best scored win; none overlaps another or a base span.

Nothing is labelled, so examples are made: base spans of a bounded sample of
texts, spans of other formats and look-alikes (dates, versions, order numbers,
numbers that fail their check digits, ...) set into those texts, with and without
words before them that tell.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, dropped, table, trim, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "id", "secret")
#: Texts that examples are made from (the least hashes of the text), natural spans used of each, and made ones.
SAMPLE, NATURAL, MADE = 3_000, 12, 6
PRECISION = 0.95
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32

SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

# --- base spans -----------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match from within a run of digits could only follow a failed one from its start, which fails alike
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str):
    """Leftmost matches around each @, so that a long run of letters is read once."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the strict formats, each kind leftmost and non-overlapping, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- candidates -----------------------------------------------------------

_DOT = r"(?:\.|\s\.\s|\sdot\s|\s?[(\[{](?:\.|\s?dot\s?)[)\]}]\s?)"
_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|(?<=\s)at(?=\s)", re.I)
_BEFORE_AT = re.compile(r"(?:(?<=\W)|^)[\w%+-]{1,30}(?:\.[\w%+-]{1,30}){0,3}\s{0,2}$")
_AFTER_AT = re.compile(rf"\s{{0,2}}[\w-]{{1,40}}(?:{_DOT}[\w-]{{2,30}}){{1,4}}", re.I)
#: Each is tried once at a run's start and reads a bounded number of characters, so texts are read in linear time.
GENERATORS = (
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:[(\[{]\.[)\]}]|[(\[{]dot[)\]}]|\s\.\s)\s?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z])){1,7}")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ./_ -]{0,2}[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])(?:\+|\(0?|)[0-9](?:[ ().0-9/ -]{5,22})[0-9](?![0-9])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    ("secret", re.compile(r"[0-9A-Za-z+/_-]{20,}+={0,2}")),
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data; they may overlap."""
    out = []
    for m in _AT.finditer(text):
        a = max(0, m.start() - 128)
        left, right = _BEFORE_AT.search(text[a : m.start()]), _AFTER_AT.match(text, m.end())
        if left and right:
            out.append(("email", a + left.start(), right.end()))
    for kind, pattern in GENERATORS:
        if kind != "secret" or len(text) >= 20:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


# --- features -------------------------------------------------------------

#: Words before a span that tell its kind, or that it is something else.
TELLING = {
    "email": "mail e-mail email contact write reach kontakt correo courriel",
    "ip": "ip host server address client gateway login from adresse",
    "card": "card visa mastercard amex credit debit payment cc karte carte tarjeta",
    "phone": "phone tel call mobile fax cell whatsapp sms telefon telefono ring",
    "iban": "iban account bank konto compte transfer",
    "id": "ssn social security id passport insurance",
    "secret": "token key secret password passwd api auth bearer credential",
}
OTHERWISE = "version release order invoice isbn issn page date on number no total price chapter commit build ref item article sku room figure file path".split()
_WORDS = re.compile(r"[^\W\d_]+")
_TELLS = {w: k for k, ws in TELLING.items() for w in ws.split()}
_GROUPS = re.compile("[0-9]+")


def _mod97(s: str) -> bool:
    s = re.sub(r"\s", "", s)
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """A span's format and surroundings as numbers."""
    s = text[start:end]
    digits, groups = _digits(s), _GROUPS.findall(s)
    before, after = text[max(0, start - 40) : start], text[end : end + 2]
    near = [w.lower() for w in _WORDS.findall(before)][-4:]
    own = sum(_TELLS.get(w) == kind for w in near)
    seps = [c for c in s if not c.isalnum()]
    letters = sum(c.isalpha() for c in s)
    ip = [int(g) for g in groups if len(g) <= 3]
    year = [g for g in groups if len(g) == 4 and g[:2] in ("19", "20")]
    freq = np.unique(list(s), return_counts=True)[1] / max(1, len(s))
    case = sum(a.islower() and b.isupper() for a, b in zip(s, s[1:]))
    return [
        KINDS.index(kind), len(s), len(digits), letters, len(seps), len(set(seps)), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0),
        13 <= len(digits) <= 19 and luhn(digits), kind == "iban" and len(s) <= 42 and _mod97(s), len(ip) == 4 and max(ip) <= 255,
        int(digits[0]) if digits else -1, s[:1] == "+" or s[:2] == "00", "(" in s, "/" in s, s.count(":"), "." in s, len(year),
        s.count("@") + len(re.findall(r"[(\[{]\s?at", s, re.I)), len(re.findall(r"\bdot\b", s, re.I)), sum(c in "abcdefABCDEF" for c in s) / max(1, letters),
        float(-(freq * np.log2(freq)).sum()), case, len(set(digits)),
        own, sum(w in _TELLS and _TELLS[w] != kind for w in near), sum(w in OTHERWISE for w in near),
        before[-1:].isalnum(), after[:1].isalnum(), before.rstrip()[-1:] in ("=", ":", "#") and before.rstrip()[-1:] != "", after[:1] == "%" or before[-1:] in "$€£" and before != "",
    ]


# --- boosted trees --------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Logistic gradient boosting on binned features: full trees of one depth, leaves by Newton steps; equal input, equal model."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(m)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    rate_of = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(rate_of / (1 - rate_of)))
    z, out = np.full(n, bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node, split_f, split_at = np.zeros(n, np.int64), np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            where = np.full((width, 2), -1)
            for j in range(m):
                key = node * (BINS + 1) + codes[:, j]
                gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better], where[better, 0], where[better, 1] = top[better], j, at[better]
            for k in np.flatnonzero(where[:, 0] >= 0).tolist():
                split_f[first + k], split_at[first + k] = where[k, 0], edges[where[k, 0]][where[k, 1]]
            node = 2 * node + (x[np.arange(n), split_f[first + node]] > split_at[first + node])
        leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + 1)
        z += leaf[node]
        out.append((split_f.tolist(), [min(t, 1e300) for t in split_at.tolist()], leaf.tolist()))
    return {"bias": bias, "trees": out}


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    z, rows = np.full(len(x), model["bias"]), np.arange(len(x))
    for split_f, split_at, leaf in model["trees"]:
        f, at, node = np.array(split_f), np.array(split_at), np.zeros(len(x), np.int64)
        for _ in range(len(leaf).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, f[node]] > at[node])
        z += np.array(leaf)[node - len(f)]
    return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least score, share of ones) of each step of the rising fit of ``y`` to ``z``."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(z[order].tolist(), y[order].tolist()):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Trees, and per kind the calibrated steps and the score from which spans are selected."""

    def __init__(self, trees: dict, steps: dict[str, list], least: dict[str, float]):
        self.trees, self.steps, self.least = trees, steps, least

    def judged(self, text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        """The spans over their kind's threshold with their calibrated score."""
        spans = [s for s in spans if s[0] in self.least]
        if not spans:
            return []
        z = raw_scores(self.trees, np.array([features(text, *s) for s in spans], float))
        out = []
        for s, v in zip(spans, z.tolist()):
            if v >= self.least[s[0]]:
                at, share = self.steps[s[0]]
                out.append((*s, share[max(0, bisect_left(at, v + 1e-12) - 1)]))
        return out

    def dumps(self) -> str:
        return json.dumps([self.trees, self.steps, self.least])

    @staticmethod
    def loads(s: str) -> Model:
        return Model(*json.loads(s))


def fit(x: np.ndarray, y: np.ndarray, seen: np.ndarray, precision: float = PRECISION) -> Model:
    """Trees from the ``seen`` examples, thresholds from the others. A kind whose precision is not reached selects nothing."""
    if not len(x) or len(np.unique(y[seen])) < 2:
        return Model({"bias": 0.0, "trees": []}, {}, {})
    trees = boost(x[seen], y[seen])
    z, steps, least = raw_scores(trees, x), {}, {}
    for n, kind in enumerate(KINDS):
        own = (x[:, 0] == n) & ~seen
        if own.any():
            at, share = isotonic(z[own], y[own])
            good = np.flatnonzero(share >= precision)
            if len(good):
                steps[kind], least[kind] = [at.tolist(), share.tolist()], float(at[good[0]])
    return Model(trees, steps, least)


# --- examples -------------------------------------------------------------


def _number(r, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _checked(r, n: int, good: bool) -> str:
    d = str(r.integers(3, 7)) + _number(r, n - 2)
    own = next(c for c in "0123456789" if luhn(d + c))
    return d + (own if good else str((int(own) + r.integers(1, 10)) % 10))


def _grouped(d: str, sep: str, size: int = 4) -> str:
    return sep.join(d[k : k + size] for k in range(0, len(d), size))


def _word(r, low: int = 3, high: int = 10) -> str:
    return "".join(r.choice(list("abcdefghiklmnoprstuvw"), r.integers(low, high)))


def _iban(r, good: bool) -> str:
    head, body = r.choice(["DE", "FR", "ES", "GB", "NL"]), _number(r, int(r.integers(12, 21)))
    check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
    return _grouped(f"{head}{(check if good else check % 97 + 1):02d}{body}", r.choice(["", " "]))


def _true(r, kind: str) -> str:
    if kind == "email":
        at, dot = [("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", " . "), ("(at)", ".")][r.integers(6)]
        return f"{_word(r)}{r.choice(['', '.' + _word(r), str(r.integers(100))])}{at}{_word(r)}{dot}{r.choice('com org net edu io de fr es co.uk example.com'.split())}"
    if kind == "ip":
        if r.random() < 0.4:
            return ":".join(f"{x:x}" for x in r.integers(1, 65536, 8)) if r.random() < 0.5 else "2001:db8::" + ":".join(f"{x:x}" for x in r.integers(1, 65536, 3))
        return r.choice(["[.]", "(.)", "[dot]", " . "]).join(map(str, r.integers(1, 256, 4)))
    if kind == "card":
        d = _checked(r, int(r.choice([13, 15, 16, 16, 16, 19])), True)
        return _grouped(d, r.choice(["", " ", "-", ".", "/", "  ", "_"]))
    if kind == "phone":
        a, b, c = str(r.integers(200, 990)), str(r.integers(200, 999)), _number(r, 4)
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}", f"00{r.integers(1, 99)} {a} {b}{c}", f"({a}){b}{c}", f"+{r.integers(1, 99)} {a} {b} {c}"][r.integers(7)]
    if kind == "iban":
        return _iban(r, True)
    if kind == "id":
        return r.choice(["-", " "]).join((str(r.integers(100, 899)), f"{r.integers(1, 99):02d}", f"{r.integers(1, 9999):04d}"))
    chars = list("0123456789abcdef") if r.random() < 0.5 else list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
    return "".join(r.choice(chars, r.integers(24, 64)))


def _false(r) -> str:
    y, mo, d = r.integers(1900, 2040), r.integers(1, 13), r.integers(1, 29)
    return [
        f"{y}-{mo:02d}-{d:02d}", f"{d:02d}.{mo:02d}.{y}", f"{d:02d}/{mo:02d}/{y} {r.integers(24):02d}:{r.integers(60):02d}", f"{y}-{mo:02d}-{d:02d}T10:{r.integers(60):02d}:{r.integers(60):02d}",
        f"978-{r.integers(1, 9)}-{_number(r, 2)}-{_number(r, 6)}-{r.integers(10)}", _checked(r, int(r.integers(13, 20)), False), _grouped(_checked(r, 16, False), r.choice([" ", "-", "."])),
        _number(r, int(r.integers(7, 13))), f"{r.integers(1, 999)} {_number(r, 3)} {_number(r, 3)}", f"{r.integers(1, 99)}.{_number(r, 3)}.{_number(r, 3)}", f"{y}-{y + 1}", f"{y} {y + 1} {y + 2}",
        ":".join(f"{x:02x}" for x in r.integers(0, 256, 6)), f"{r.integers(24):02d}:{r.integers(60):02d}:{r.integers(60):02d}", f"{r.integers(10)}.{r.integers(20)}.{r.integers(20)}-{r.integers(999)}",
        _iban(r, False), "_".join(_word(r) for _ in range(4)), "/".join(_word(r) for _ in range(5)), "-".join(_word(r) for _ in range(4)), "".join(_word(r).title() for _ in range(4)), _word(r, 20, 40),
        f"{_word(r)} @ {r.integers(99)}.{r.integers(10, 99)}", f"{_word(r)} at {_word(r)}. {_word(r).title()}", f"{_word(r)} at {_word(r)}.{_word(r).title()} {_word(r)}", r.choice(["-", "=", "_"]) * int(r.integers(20, 60)),
        f"{r.integers(1, 90)}-{r.integers(90, 180)} {r.integers(1, 90)}-{r.integers(90, 180)}", f"{r.integers(100, 999)}-{r.integers(100, 999)}", f"{r.integers(1, 50)}.{r.integers(1000, 9999)}, {r.integers(1, 50)}.{r.integers(1000, 9999)}",
    ][r.integers(28)]


def examples(text: str, seed: int) -> tuple[list[list[float]], list[int]]:
    """Features and labels of spans of a text, and of spans set into it."""
    r, x, y = np.random.default_rng(seed), [], []
    piece = text[(a := int(r.integers(0, max(1, len(text) - 4_000)))) : a + 4_000]  # natural spans of a piece of bounded length
    base = {(k, s, e) for k, s, e in base_spans(piece)}
    found = candidates(piece)
    for k in sorted(r.choice(len(found), min(NATURAL, len(found)), replace=False).tolist()) if found else ():
        kind, s, e = found[k]
        if (kind, s, e) in base:
            label = 1
        elif kind == "card" and not luhn(_digits(piece[s:e])) or any(s < b and a < e for _, a, b in base):
            label = 0  # fails its check, or is a part or the wrong kind of something known
        else:
            continue  # not known
        x.append(features(piece, kind, s, e))
        y.append(label)
    words = piece.split() or [""]
    for _ in range(MADE):
        kind = KINDS[r.integers(len(KINDS))] if r.random() < 0.5 else None
        made = _true(r, kind) if kind else _false(r)
        k = int(r.integers(len(words)))
        tell = TELLING[kind].split() if kind else OTHERWISE
        told = f"{r.choice(tell)}{r.choice(['', ':', ' =', ' no.'])} " if r.random() < 0.5 else ""
        head = " ".join(words[max(0, k - 8) : k]) + " " + told + r.choice(["", "", '"', "("])
        own = head + made + r.choice(["", "", ".", '"', ")", ","]) + " " + " ".join(words[k : k + 6])
        for c, s, e in candidates(own):
            if s < len(head) + len(made) and e > len(head):
                shared = min(e, len(head) + len(made)) - max(s, len(head))
                x.append(features(own, c, s, e))
                y.append(int(c == kind and shared >= 0.9 * len(made) and e - s <= len(made) + 2))
    return x, y


def _made(sample: list[int]):
    """Texts (hash, text) -> (hash, features, labels) of the sampled ones, each once a task."""
    wanted = frozenset(sample)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for k, h in enumerate(b.column(0).to_pylist()):
                if h in wanted and h not in seen:
                    seen.add(h)
                    x, y = examples(b.column(1)[k].as_py(), h & 0x7FFFFFFF)
                    if x:
                        yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([[float(v) for r in x for v in r]]), pa.array([y], pa.list_(pa.int32()))], names=["h", "x", "y"])
        trim()

    return run


def _fitted(precision: float):
    """All examples, in one task -> the model as one row."""

    def run(batches):
        rows = sorted((h, x, y) for b in batches for h, x, y in zip(*(b.column(k).to_pylist() for k in range(3))))
        y = np.array([v for r in rows for v in r[2]], float)
        x = np.array([v for r in rows for v in r[1]], float).reshape(len(y), -1)
        seen = np.array([r[0] % 4 != 0 for r in rows for _ in r[2]], bool)
        yield pa.RecordBatch.from_arrays([pa.array([fit(x, y, seen, precision).dumps()])], names=["model"])
        trim()

    return run


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, precision: float = PRECISION) -> Model:
    """The model, from at most ``sample`` different texts (those of the least hashes), whatever the rows' order and number.

    Null and empty texts are not learned from; without any text a model selects
    nothing. At most NATURAL + a few times MADE examples come from a text, so
    the fit, in one task, is of bounded size.
    """
    arrow_rows(docs.sparkSession)
    d = docs.select(F.col(text_col).cast("string").alias("t")).where("t <> ''").select(F.xxhash64("t").alias("h"), "t")
    # hashes only, and only of the sample: at most ``sample`` numbers
    wanted = [r.h for r in d.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not wanted:
        return Model({"bias": 0.0, "trees": []}, {}, {})
    own = d.where(F.col("h") <= wanted[-1]).mapInArrow(_made(wanted), "h long, x array<double>, y array<int>")
    made = written(own.groupBy("h").agg(F.min(F.struct("x", "y")).alias("r")).select("h", "r.x", "r.y"), "examples")
    row = made.coalesce(1).mapInArrow(_fitted(precision), "model string").first()
    dropped(made)
    return Model.loads(row.model) if row else Model({"bias": 0.0, "trees": []}, {}, {})


# --- the operator ---------------------------------------------------------


def spans_of(text: str, model: Model) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind and start: base spans, and selected ones that overlap no other."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    merged: list[tuple[int, int]] = []
    for s, e in taken:  # base spans may overlap one another
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))

    def free(s: int, e: int) -> bool:
        k = bisect_left(merged, (e, -1))
        return k == 0 or merged[k - 1][1] <= s

    open_spans = [c for c in candidates(text) if free(c[1], c[2])]
    out = [(k, s, e, 1.0, True) for k, s, e in base]
    for kind, s, e, score in sorted(model.judged(text, open_spans), key=lambda c: (-c[3], c[1], -c[2], KINDS.index(c[0]))):
        if free(s, e):
            insort(merged, (s, e))
            out.append((kind, s, e, score, False))
    return sorted(out, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def _found(model: str, at: int | None):
    """Rows -> (id, spans), or with ``at`` (a column's place) the rows with the spans of that text made unreadable."""
    names = ("kind", "start", "end", "score", "base")

    def run(batches):
        own = Model.loads(model)
        for b in batches:
            texts = b.column(1 if at is None else at).to_pylist()
            if at is None:
                rows = [[dict(zip(names, s)) for s in spans_of(t or "", own)] for t in texts]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["id", "spans"])
            else:
                new = pa.array([None if t is None else redacted(t, spans_of(t, own)) for t in texts], b.column(at).type)
                yield b.set_column(at, b.schema.field(at), new)
        trim()

    return run


def redacted(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first kind, over all that they cover."""
    out, at = [], 0
    for kind, s, e, *_ in sorted(spans, key=lambda c: (c[1], -c[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): per row the spans of personal data, in code points, end exclusive, by kind and start.

    Null and empty texts have none. Repeated rows and null ids give a row each;
    an empty table gives none. Whole texts of any length are read, in linear
    time.
    """
    arrow_rows(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_found(model.dumps(), None), f"id long, spans {SPANS}")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all columns as they are and [KIND] for each span of the text."""
    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(_found(model.dumps(), docs.columns.index(text_col)), docs.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = F.filter("spans", lambda s: s["base"])
    own = find(docs, train(docs)).select("id", "spans", base.alias("base"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return own.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
