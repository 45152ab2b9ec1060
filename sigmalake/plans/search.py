"""Ranked search: any number of queries in one job, each step keyed by query_id.

Query clauses are made on the driver. Those of up to PUSHED_TERMS distinct terms
are weighted there, from one lookup of their terms; a filter on the terms then
reaches the scan of the postings, and what matches of both indexes is shuffled
once, by query and page. More clauses are joined as tables, by shuffle where
they are large.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import scoring
from ..functions.terms import clause_table, query_clauses
from ..operators.index import KINDS, Index

CLAUSES = "query_id long, clause int, term string, level int, generalization boolean"
WEIGHTS = "query_id long, clause int, level int, generalization boolean, boost double, df long, idf double, n_clauses long, query_norm double"
#: Rows (clauses, results of a page) up to which a side is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Distinct terms up to which the scan of the postings is filtered by them, and up to which their weights stand in the plan itself.
PUSHED_TERMS = 1_000
FEW_TERMS = 64


@dataclass(frozen=True)
class Weighted:
    """Weighted clauses of a bounded number: for each kind of index, rows of WEIGHTS by term, and the term's postings by norm."""

    rows: dict[str, dict[str, list[dict]]]
    blocks: dict[str, dict[str, dict[float, int]]]

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        own = spark.range(1).select(F.explode(self.by_term(kind)).alias("term", "w"))
        return own.select("term", F.inline("w"))

    def by_term(self, kind: str):
        """The weights as one literal, a map of arrays."""
        fields = ", ".join("{}: {}".format(*f.split()) for f in WEIGHTS.split(", "))
        return F.from_json(F.lit(json.dumps(self.rows[kind])), f"map<string, array<struct<{fields}>>>")


#: Clauses as ``clauses`` makes them, or weighted ones.
Clauses = DataFrame | Weighted


def clauses(spark: SparkSession, queries: Iterable[tuple[int, str]], settings: Settings = DEFAULT) -> DataFrame:
    """The clauses of (query_id, LaTeX) pairs with their boost."""
    return _clauses(spark, query_clauses(queries, settings))


def _clauses(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CLAUSES).withColumn("boost", scoring.boost(F.col("generalization")))


def clauses_of(queries: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``clauses`` of a table of queries (query_id, query): nothing of it comes to the driver."""
    return clause_table(queries, settings=settings).withColumn("boost", scoring.boost(F.col("generalization")))


def prepared(index: Index, queries: Iterable[tuple[int, str]], settings: Settings = DEFAULT) -> tuple[Index, Clauses]:
    """The index cut to the queries' terms, and their clauses.

    Up to PUSHED_TERMS distinct terms become a filter that reaches the scan of
    the postings, which lie in the order of terms: few row groups are read. Up
    to BROADCAST_ROWS of their clauses are weighted here, in one job.
    """
    rows = query_clauses(queries, settings)
    terms = sorted({row[2] for row in rows})
    if len(terms) > PUSHED_TERMS:
        return index, _clauses(index.pages.sparkSession, rows)
    cut = lambda tables: {k: d.where(F.col("term").isin(terms)) for k, d in tables.items()}
    index = replace(index, postings=cut(index.postings), blocks=cut(index.blocks))
    if len(rows) > BROADCAST_ROWS:
        return index, _clauses(index.pages.sparkSession, rows)
    # a row for each term, norm and kind, and the two sizes
    sides = [index.blocks[k].selectExpr(f"'{k}' kind", "term", "norm", "n") for k in KINDS]
    sides += [index.sizes[k].selectExpr(f"'{k}' kind", "null term", "0.0D norm", "n_docs n") for k in KINDS]
    sizes, blocks = dict.fromkeys(KINDS, 0), {k: {t: {} for t in terms} for k in KINDS}
    for r in sides[0].union(sides[1]).union(sides[2]).union(sides[3]).collect():
        if r.term is None:
            sizes[r.kind] = r.n
        else:
            blocks[r.kind][r.term][r.norm] = r.n
    weights = {k: _weights(rows, sizes[k], {t: sum(b.values()) for t, b in blocks[k].items()}) for k in KINDS}
    return index, Weighted(weights, blocks)


def _weights(rows: list[tuple], n_docs: int, df: dict[str, int]) -> dict[str, list[dict]]:
    """Rows of ``weighted``, computed on the driver."""
    clauses, square = Counter(r[0] for r in rows), defaultdict(float)
    idf = {t: scoring.idf_of(n_docs, n) for t, n in df.items()}
    boost = lambda general: scoring.GENERAL_BOOST if general else 1.0
    for query_id, _, term, _, general in rows:
        square[query_id] += (idf[term] * boost(general)) ** 2
    out = defaultdict(list)
    for query_id, clause, term, level, general in rows:
        qn = square[query_id] ** -0.5 if square[query_id] else None
        values = (query_id, clause, level, general, boost(general), df[term], idf[term], clauses[query_id], qn)
        out[term].append(dict(zip((f.split()[0] for f in WEIGHTS.split(", ")), values)))
    return dict(out)


def weighted(index: Index, kind: str, q: Clauses) -> DataFrame:
    """Clauses with idf (unknown terms have df 0), and per query n_clauses and query_norm."""
    if isinstance(q, Weighted):
        return q.table(index.pages.sparkSession, kind)
    stats = q.select("term").distinct().join(index.term_stats[kind], "term")
    w = q.join(stats, "term", "left").crossJoin(F.broadcast(index.sizes[kind]))  # one row
    w = w.withColumn("df", F.coalesce("df", F.lit(0))).withColumn("idf", scoring.idf(F.col("n_docs"), F.col("df")))
    own = W.partitionBy("query_id")
    square = F.pow(F.col("idf") * F.col("boost"), F.lit(2))
    return w.select(
        "query_id", "clause", "term", "level", "generalization", "boost", "df", "idf",
        F.count("*").over(own).alias("n_clauses"), (1 / F.sqrt(F.sum(square).over(own))).alias("query_norm"),
    )


def matches(index: Index, kind: str, q: Clauses, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, clause, term, ..., doc_id, page_id, norm, proximity, part) of every clause that a document matches.

    part = idf^2 x boost x proximity.
    """
    p = index.postings[kind]
    if isinstance(q, Weighted) and len(q.rows[kind]) <= FEW_TERMS:
        m = p.select("*", F.inline(F.try_element_at(q.by_term(kind), F.col("term"))))
    elif isinstance(q, Weighted):
        m = p.join(F.broadcast(weighted(index, kind, q)), "term")  # at most BROADCAST_ROWS clauses
    else:
        m = p.join(weighted(index, kind, q), "term")
    near = (settings.fold or scoring.proximity)(F.col("level"), F.col("levels"))
    return m.select("*", near.alias("proximity"), (F.col("idf") * F.col("idf") * F.col("boost") * near).alias("part"))


MATCHED = ("query_id", "page_id", "doc_id", "part", "n_clauses", "query_norm", "norm")


def _scored(m: DataFrame, *keys: str) -> DataFrame:
    """Matches to documents. They are dealt by (query, page) once; every grouping after it keeps that partitioning."""
    score = "count(*) / first(n_clauses) * first(query_norm) * first(norm) * sum(part)"
    by = m.repartition("query_id", "page_id").groupBy("query_id", "page_id", "doc_id", *keys)
    return by.agg(F.count("*").alias("matched"), F.expr(score).alias("score"))


def search_documents(index: Index, kind: str, q: Clauses, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, doc_id, page_id, matched, score) of all documents that match some clause."""
    return _scored(matches(index, kind, q, settings).select(*MATCHED)).select("query_id", "doc_id", "page_id", "matched", "score")


def best_formulas(index: Index, q: Clauses, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, page_id, formula_id, formula_score): of each page the formula that ranks first, the smaller id among equals.

    One aggregation with map-side partials, no window over a page's formulas.
    """
    hits = search_documents(index, "formula", q, settings)
    best = F.max_by(F.struct("doc_id", "score"), F.struct("score", -F.col("doc_id"))).alias("b")
    return hits.groupBy("query_id", "page_id").agg(best).select("query_id", "page_id", F.col("b.doc_id").alias("formula_id"), F.col("b.score").alias("formula_score"))


def search_pages(index: Index, q: Clauses, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, page_id, page_score)."""
    return search_documents(index, "page", q, settings).select("query_id", "page_id", F.col("score").alias("page_score"))


def search(index: Index, q: Clauses, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, page_id, formula_id, formula_score, page_score, score), unordered: every page that matches.

    ``best_formulas`` and ``search_pages`` in one: the matches of both indexes
    are shuffled together, and no join is left.
    """
    both = [matches(index, k, q, settings).select(*MATCHED, F.lit(k == "formula").alias("formula")) for k in KINDS]
    best = "max_by(struct(doc_id, score), struct(score, -doc_id)) filter (where formula)"
    found = _scored(both[0].union(both[1]), "formula").groupBy("query_id", "page_id").agg(
        F.expr(best).alias("b"), F.expr("max(score) filter (where not formula)").alias("page_score")
    )
    found = found.where("b is not null and page_score is not null")
    merged = scoring.merged(F.col("b.score"), F.col("page_score"), settings).alias("score")
    return found.select("query_id", "page_id", F.col("b.doc_id").alias("formula_id"), F.col("b.score").alias("formula_score"), "page_score", merged)


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """Ranks after the first and up to the second; ValueError if there is no such page."""
    if page <= 0:
        raise ValueError("page <= 0")
    if size <= 0:
        raise ValueError("size <= 0")
    return (page - 1) * size, page * size


def ranked(results: DataFrame, digits: int = 10) -> DataFrame:
    """``results`` with rank 1, 2, ... per query: score descending, then page_id.

    Scores that differ by floating point noise only count as equal.
    """
    order = W.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "page_id")
    return results.withColumn("rank", F.row_number().over(order))


def result_page(results: DataFrame, page: int = 1, size: int = 10, digits: int = 10) -> DataFrame:
    """The rows of ``ranked`` on one page of each query; only the top of each partition is sorted (group limit)."""
    start, stop = page_bounds(page, size)
    return ranked(results, digits).where((F.col("rank") > start) & (F.col("rank") <= stop))


def total_hits(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.count("*").alias("total"))


def with_attributes(index: Index, page_rows: DataFrame, settings: Settings = DEFAULT, most: int | None = None) -> DataFrame:
    """Result rows with formula, doc_title and doc_url, looked up for the rows of the page only.

    ``most`` is a bound of their number, if the caller knows one (queries x
    size): up to BROADCAST_ROWS they are broadcast, else Spark decides.
    """
    near = (lambda d: F.broadcast(d)) if most is not None and most <= BROADCAST_ROWS else (lambda d: d)
    f = index.formulas.select("formula_id", F.col("latex").alias("formula"))
    p = index.pages.select("page_id", F.col("title").alias("doc_title"))
    out = f.join(near(page_rows), "formula_id")
    out = p.join(near(out), "page_id")
    return out.withColumn("doc_url", scoring.wiki_url(F.col("doc_title"), settings))


def top_rows(index: Index, results: DataFrame, page: int, size: int, settings: Settings = DEFAULT, digits: int = 10) -> list[dict]:
    """The rows of one query's result page with their rank and attributes, in order.

    Only the top of each partition is sorted. The page's ids (at most
    ``size``) then reach the scans of formulas and pages, which lie in the order
    of ids.
    """
    start, stop = page_bounds(page, size)
    top = results.orderBy(F.round("score", digits).desc(), "page_id").limit(stop).collect()[start:]
    if not top:
        return []
    titled = index.pages.where(F.col("page_id").isin([r.page_id for r in top]))
    titled = titled.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "title", scoring.wiki_url(F.col("title"), settings).alias("doc_url"))
    latex = index.formulas.where(F.col("formula_id").isin([r.formula_id for r in top]))
    latex = latex.select(F.lit("formula").alias("kind"), F.col("formula_id").alias("id"), F.col("latex").alias("title"), F.lit(None).cast("string").alias("doc_url"))
    own = {(r.kind, r.id): r for r in titled.union(latex).collect()}  # one job for both
    return [
        r.asDict() | {"rank": start + n, "formula": own["formula", r.formula_id].title, "doc_title": own["page", r.page_id].title, "doc_url": own["page", r.page_id].doc_url}
        for n, r in enumerate(top, 1)
    ]
