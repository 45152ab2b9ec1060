"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps one bit per failed
rule together with the measurements, so a policy (a named, versioned set of
rules) is a mask, changing a policy never rereads the texts, and ablations are
bitwise aggregations over at most ``2 ** len(RULES)`` distinct masks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, words_of

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the ledger's measurements; ``bit`` is the rule's place for good."""

    bit: int
    name: str
    failed: str


#: Bits are never reused: a retired rule keeps its bit.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(5, "no_letters", "n_words > 0 and 100 * n_letter_words < 60 * n_words"),
)

#: Versioned policies: which rules reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "no_letters"),
}


def mask_of(names) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def _repeat_words(h: str) -> tuple[Column, Column]:
    """Steps from the window hashes in column ``h``: (sorted (hash, place) pairs or null, places of repeated windows)."""
    pairs = F.when(
        F.size(h) > F.size(F.array_distinct(h)),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )
    same = lambda p, j: F.coalesce(F.get(F.col("_pairs"), j)["x"] == p["x"], F.lit(False))
    places = F.sort_array(
        F.transform(F.filter("_pairs", lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"])
    )
    return pairs, places


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_letter_words, n_repeat_words.

    Null and empty texts have no words and measure 0 everywhere. Repeated rows
    and null ids give a row each. Other columns of ``docs`` are not read. A text
    is one row of one task however long it is; all steps over it are O(n log n).
    Equal windows are found by a 64-bit hash of their five words, so two
    different windows of one text count as equal with a chance of n^2 / 2^65.
    """
    d = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.select(
        id_col,
        "_text",
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    span = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)])
    d = d.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.when(F.size("_words") >= WINDOW, F.transform(span, window)).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    names = [c for c in d.columns if c != "_h"]
    pairs, places = _repeat_words("_h")
    d = d.select(*names, pairs.alias("_pairs"))
    d = d.select(*names, places.alias("_at"))
    step = lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))
    covered = F.aggregate(
        F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), step), F.lit(0), lambda acc, x: acc + x
    )
    return d.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` plus ``fail_bits`` (long), bit ``r.bit`` set where rule ``r`` fails."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    m = measure(docs, id_col, text_col)
    return m.select("*", bits.alias("fail_bits"))


def apply_policy(book: DataFrame, version: str) -> DataFrame:
    """``book`` with ``kept``: no rule of the policy failed. No text is read again."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablation(book: DataFrame, version: str) -> DataFrame:
    """Per rule of the policy: rule, n_failed, n_only (rejected by this rule alone), n_kept_without.

    First counts the distinct masks (at most 2 ** rules rows leave each task),
    then reads every figure off the masks.
    """
    mask = mask_of(POLICIES[version])
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[version]]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in rules]))
    s = seen.select("m", "n", each.alias("r")).select("m", "n", "r.rule", "r.b")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rest = F.lit(mask).bitwiseXOR(F.col("b"))
    return s.groupBy("rule").agg(
        total(F.col("m").bitwiseAND(F.col("b")) != 0).alias("n_failed"),
        total(F.col("m") == F.col("b")).alias("n_only"),
        total(F.col("m").bitwiseAND(rest) == 0).alias("n_kept_without"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(table(spark, sf_dir, "documents")), "v2")
    base = mask_of(POLICIES["base"])
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "fail_bits",
    )


OP1_SQL = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
m as (select doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, len(ls)::bigint n_lines,
             (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}')))::bigint n_letter_words from w),
g as (select doc_id, unnest(range(1, len(ws) - 3)) i, ws from w where len(ws) >= 5),
k as (select doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') s from g),
r as (select doc_id, i from k qualify count(*) over (partition by doc_id, s) > 1),
c as (select doc_id, count(distinct i + o)::bigint n from r, (select unnest([0, 1, 2, 3, 4]) o) group by doc_id),
a as (select m.*, coalesce(c.n, 0)::bigint n_repeat_words from m left join c using (doc_id)),
f as (select *, (case when n_words < 10 then 1 else 0 end)
  + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
  + (case when 10 * n_symbols > n_words then 4 else 0 end)
  + (case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end)
  + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end)
  + (case when n_words > 0 and 100 * n_letter_words < 60 * n_words then 32 else 0 end) b from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, b = 0 kept, b::bigint fail_bits from f
"""
