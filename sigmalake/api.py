"""Search, label and evaluation calls with JSON answers."""

from __future__ import annotations

import json
import time
from dataclasses import replace

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .config import DEFAULT, Settings
from .functions import latex as latex_reader
from .functions import mathml
from .operators.index import Index
from .plans import evaluate as evaluation
from .plans import explain, search, topk
from .sources import labels as label_table


def failure(message: str) -> str:
    return json.dumps({"status": "Fail", "message": message})


def search_json(index: Index, query: str, page: int = 1, size: int = 10, settings: Settings = DEFAULT) -> str:
    """A page of results; {"status": "Fail", ...} for an empty or unreadable query or a page that cannot be."""
    if not query:
        return failure("need query parameter")
    try:
        answer = _answer(index, query, page, size, settings)
    except ValueError as e:
        return failure(str(e))
    return json.dumps(answer, ensure_ascii=False)


def _answer(index: Index, query: str, page: int, size: int, settings: Settings) -> dict:
    search.page_bounds(page, size)
    head = {"status": "OK", "query_mathml": mathml.render(latex_reader.parse(query)), "query_detail": explain.query_html(query, settings)}
    began = time.monotonic()
    index, q = search.prepared(index, [(0, query)], settings)
    if topk.worthwhile(q):
        total = topk.total_hits(index, q)
        rows = search.top_rows(index, topk.top_k(index, q, page * size, settings), page, size, settings)
    else:  # counted while the best are found
        hits = Observation()
        rows = search.top_rows(index, search.search(index, q, settings).observe(hits, F.count("*").alias("n")), page, size, settings)
        total = hits.get["n"]
    seconds = str(round(time.monotonic() - began, 3))
    if not total:
        return head | {"results": [], "time": seconds}
    why: dict[tuple, list] = {}
    for kind, column in (("formula", "formula_id"), ("page", "page_id")) if rows else ():
        ids = [r[column] for r in rows]
        own = replace(index, postings=index.postings | {kind: index.postings[kind].where(F.col("doc_id").isin(ids))})
        for r in explain.explain_scores(own, kind, q, settings=settings).collect():
            why.setdefault((kind, r.doc_id), []).append(r)
    shown = [
        {
            "doc": {"formula_id": r["formula_id"], "formula": r["formula"], "doc_id": r["page_id"], "doc_title": r["doc_title"], "doc_url": r["doc_url"]},
            "score": r["score"],
            "explain": f"<div>{explain.score_html(why.get(('formula', r['formula_id']), []))}</div>"
            f"<div style='background-color:gray'>{explain.score_html(why.get(('page', r['page_id']), []))}</div>",
        }
        for r in rows
    ]
    return head | {"results": shown, "page": page, "pageSize": size, "total": total, "time": seconds}


def label_json(labels, query: str, url: str) -> str:
    row = labels.where((F.col("query") == query) & (F.col("url") == url)).first()
    return json.dumps({"status": "OK", "label": row.relevance if row else 0})


def put_label_json(spark, path: str, query: str, url: str, relevance: int) -> str:
    """Stores a label; relevance 0 takes it out."""
    label_table.store(spark.createDataFrame([(query, url, relevance)], label_table.SCHEMA), path)
    return json.dumps({"status": "OK"})


def dcg_json(index: Index, labels, k: int, settings: Settings = DEFAULT) -> str:
    details = evaluation.evaluate(index, labels, k, settings).orderBy("query").cache()
    mean = evaluation.mean_quality(details).first()
    rows = [r.asDict() for r in details.collect()]  # one row per labelled query
    details.unpersist()
    return json.dumps({"dcg": mean.dcg, "precision": mean.precision, "details": rows}, ensure_ascii=False)
