"""Scoring expressions, all plain Column arithmetic."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

GENERAL_BOOST = 0.5


def boost(generalization: Column) -> Column:
    return F.when(generalization, F.lit(GENERAL_BOOST)).otherwise(F.lit(1.0))


def idf(n_docs: Column, df: Column) -> Column:
    """1 + ln(N / (df + 1))."""
    return 1 + F.ln(n_docs / (df + 1))


def idf_of(n_docs: int, df: int) -> float:
    """``idf`` of two numbers; nothing indexed: nothing to weigh."""
    return 1 + log(n_docs / (df + 1)) if n_docs else 0.0


def norm(length: Column) -> Column:
    """1 / length, cut to two binary digits after the leading one; 0 for a document without terms."""
    unit = F.pow(F.lit(2.0), F.ceil(F.log2(length)) + 2)
    return F.when(length > 0, F.floor(unit / length) / unit).otherwise(F.lit(0.0))


def proximity(query_level: Column, levels: Column) -> Column:
    """Best 1 / (1 + distance of levels) over a term's levels in a document."""
    return F.array_max(F.transform(levels, lambda x: 1 / (1 + F.abs(query_level - x))))


def merged(formula_score: Column, page_score: Column, settings: Settings = DEFAULT) -> Column:
    return formula_score * settings.formula_weight + page_score * settings.page_weight


def dcg_gain(relevance: Column, rank: Column) -> Column:
    """(2 ** (relevance - 1) - 1) / log2(rank + 1) for a positive relevance, else 0."""
    gain = (F.pow(F.lit(2.0), relevance - 1) - 1) / F.log2(rank + 1)
    return F.when(relevance > 0, gain).otherwise(F.lit(0.0))


def wiki_url(title: Column, settings: Settings = DEFAULT) -> Column:
    return F.concat(F.lit(settings.url_prefix), F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))))
