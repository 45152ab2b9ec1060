"""Retrieval quality and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import scoring
from ..operators.index import Index
from ..operators.scratch import written
from ..sources import labels as label_table
from ..sources.wiki import numbered
from .search import clauses_of, result_page, search, with_attributes


def quality(judged: DataFrame, k: int) -> DataFrame:
    """(query, dcg, active, precision) of ranked, labelled rows (query, rank, relevance). Precision is over k, not over the rows found."""
    top = judged.where(F.col("rank") <= k)
    return top.groupBy("query").agg(
        F.sum(scoring.dcg_gain(F.col("relevance"), F.col("rank"))).alias("dcg"),
        F.count_if(F.col("relevance") > 0).alias("active"),
        (F.count_if(F.col("relevance") > 1) / F.lit(float(k))).alias("precision"),
    )


def mean_quality(details: DataFrame) -> DataFrame:
    """(dcg, precision): means over all queries."""
    return details.agg(F.avg("dcg").alias("dcg"), F.avg("precision").alias("precision"))


def evaluate(index: Index, labels: DataFrame, k: int, settings: Settings = DEFAULT) -> DataFrame:
    """``quality`` of every labelled query; a query without results scores 0.

    However many queries: they are numbered, broken into clauses, weighted,
    searched and judged as tables, and the driver sees none of them.
    """
    ids = written(numbered(labels.select("query").distinct(), ["query"], "query_id"), "labelled")
    q = written(clauses_of(ids, settings), "clauses")
    top = result_page(search(index, q, settings), 1, k)
    shown = with_attributes(index, top, settings).join(ids, "query_id")
    judged = label_table.lookup(shown.select("query", F.col("doc_url").alias("url"), "rank"), labels)
    found = ids.join(quality(judged, k), "query", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("dcg", "double"), ("active", "long"), ("precision", "double"))}
    return found.select("query", *zero.values())


def latency(samples: DataFrame, column: str) -> DataFrame:
    """(min, max, avg, median, count): one row; the median is exact."""
    x = F.col(column)
    return samples.agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.percentile(x, F.lit(0.5)).alias("median"), F.count(x).alias("count")
    )
