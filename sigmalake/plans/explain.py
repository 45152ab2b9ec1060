"""Explanations of queries and scores, as tables and as HTML."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.terms import terms_of
from ..operators.index import Index
from .search import Clauses, matches


def explain_terms(q: DataFrame) -> DataFrame:
    """(query_id, clause, term, level, generalization)."""
    return q.select("query_id", "clause", "term", "level", "generalization")


def explain_scores(index: Index, kind: str, q: Clauses, docs: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Per matched clause of a document: idf, boost, proximity, coord, query_norm, norm and its contribution; they add up to the score.

    ``docs`` (query_id, doc_id) narrows it to some documents.
    """
    m = matches(index, kind, q, settings)
    if docs is not None:
        m = m.join(docs.select("query_id", "doc_id"), ["query_id", "doc_id"])
    # a document has at most a row for each clause of a query
    matched = F.count("*").over(W.partitionBy("query_id", "doc_id"))
    m = m.withColumn("coord", matched / F.col("n_clauses"))
    worth = F.col("coord") * F.col("query_norm") * F.col("norm") * F.col("part")
    return m.select("query_id", "doc_id", "clause", "term", "idf", "boost", "proximity", "coord", "query_norm", "norm", worth.alias("contribution"))


def query_html(latex: str, settings) -> str:
    """The terms of a query as an HTML list; empty without any."""
    items = [
        f"<li>term: <code class='xml'>{escape(t.term, quote=False)}</code>, level: <code>{t.level}</code>, "
        f"generalization: <code>{str(t.generalization).lower()}</code></li>"
        for t in terms_of(latex, settings)
    ]
    return f"<ul>{''.join(items)}</ul>" if items else ""


def score_html(rows) -> str:
    """Rows of ``explain_scores`` for one document as an HTML list."""
    items = [
        f"<li>{r.contribution:.6g} = <code>{escape(r.term, quote=False)}</code>: coord {r.coord:.4g}, query norm {r.query_norm:.4g}, "
        f"norm {r.norm:.4g}, idf {r.idf:.4g}, boost {r.boost:g}, proximity {r.proximity:.4g}</li>"
        for r in sorted(rows, key=lambda r: r.clause)
    ]
    return f"<ul>{sum(r.contribution for r in rows):.6g}{''.join(items)}</ul>" if items else ""


