"""Formulas to terms on Spark: one Arrow pass, no shuffle; equal formulas of a batch are read, and their results made, once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from . import latex as latex_reader
from . import mathml as mathml_reader
from .mathtree import Term, normalise, terms

ANALYSIS = "terms array<struct<term:string,level:int,generalization:boolean>>, folded array<struct<term:string,levels:array<int>>>, tree string, is_error boolean"
_TERM = pa.struct([("term", pa.string()), ("level", pa.int32()), ("generalization", pa.bool_())])
_FOLDED = pa.struct([("term", pa.string()), ("levels", pa.list_(pa.int32()))])
_ANALYSED = [("terms", pa.list_(_TERM)), ("folded", pa.list_(_FOLDED)), ("tree", pa.string()), ("is_error", pa.bool_())]
COUNTED = "folded array<struct<term:string,levels:array<int>>>, n_terms int, is_error boolean"
_COUNTED = [("folded", pa.list_(_FOLDED)), ("n_terms", pa.int32()), ("is_error", pa.bool_())]


def tree_of(formula: str, settings: Settings = DEFAULT, mathml: bool = False):
    """The normalised tree of a LaTeX formula, or of MathML text; MathError if it cannot be read."""
    return normalise(mathml_reader.parse(formula) if mathml else latex_reader.parse(formula), settings)


def terms_of(formula: str, settings: Settings = DEFAULT, mathml: bool = False) -> list[Term]:
    return list(terms(tree_of(formula, settings, mathml), settings.generalise))


def folded(found: list[Term]) -> list[dict]:
    """Terms once each, with their levels: what a formula's postings are made of."""
    levels: dict[str, set[int]] = {}
    for t in found:
        levels.setdefault(t.term, set()).add(t.level)
    return [{"term": t, "levels": sorted(own)} for t, own in levels.items()]


@lru_cache(maxsize=20_000)
def analysed(formula: str, settings: Settings, mathml: bool) -> tuple[list[Term], str | None, bool]:
    """(terms, tree, is_error) of a formula: whatever is wrong with it makes it an error of its own, never of the job."""
    try:
        tree = tree_of(formula, settings, mathml)
        return list(terms(tree, settings.generalise)), str(tree), False
    except (ValueError, IndexError, RecursionError):
        return [], None, True


def results(formulas: pa.Array, settings: Settings = DEFAULT, mathml: bool = False, counted: bool = False) -> pa.Array:
    """The results of a batch, as ``analyse`` (or ``analyse_folded``: ``counted``) gives them.

    Rows take them by the place of their formula: only different formulas pass through Python objects.
    """
    coded = pc.fill_null(formulas, "").dictionary_encode()
    rows = [([], None, False) if not f else analysed(f, settings, mathml) for f in coded.dictionary.to_pylist()]
    if counted:
        out, kind = [{"folded": folded(ts), "n_terms": len(ts), "is_error": bad} for ts, _, bad in rows], pa.struct(_COUNTED)
    else:
        out, kind = [{"terms": [t._asdict() for t in ts], "folded": folded(ts), "tree": tree, "is_error": bad} for ts, tree, bad in rows], pa.struct(_ANALYSED)
    return pa.array(out, kind).take(coded.indices)


def _udf(formula: Column, schema: str, make) -> Column:
    """Marked as not deterministic, so that Spark never calls it twice for a row."""

    def run(column: pa.Array) -> pa.Array:
        return make(column)

    return F.arrow_udf(run, schema).asNondeterministic()(formula)


def analyse(formula: Column, settings: Settings = DEFAULT, mathml: bool = False) -> Column:
    """Struct (terms, folded, tree, is_error) of a formula column. A null or empty formula has no terms and is no error."""
    return _udf(formula, ANALYSIS, lambda column: results(column, settings, mathml))


def analyse_folded(formula: Column, settings: Settings = DEFAULT) -> Column:
    """Struct (folded, n_terms, is_error), as ``analyse`` has them: what an index needs, and no more of it passes from Python."""
    return _udf(formula, COUNTED, lambda column: results(column, settings, counted=True))


def explode_terms(formulas: DataFrame, column: str = "latex", settings: Settings = DEFAULT, mathml: bool = False) -> DataFrame:
    """The rows of ``formulas`` once per term: all columns, ord, term, level, generalization. Without terms: no row."""
    each = formulas.select("*", analyse(F.col(column), settings, mathml).alias("_a"))
    each = each.select(*formulas.columns, F.posexplode("_a.terms").alias("ord", "_t"))
    return each.select(*formulas.columns, "ord", "_t.term", "_t.level", "_t.generalization")


def clause_table(queries: DataFrame, column: str = "query", settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, clause, term, level, generalization) of a table of queries (query_id, query), however many; made by the workers."""
    each = explode_terms(queries.select("query_id", column), column, settings)
    return each.select("query_id", F.col("ord").alias("clause"), "term", "level", "generalization")


def query_clauses(queries: Iterable[tuple[int, str]], settings: Settings = DEFAULT) -> list[tuple]:
    """(query_id, clause, term, level, generalization) of LaTeX queries; one that cannot be read has none."""
    out = []
    for query_id, formula in queries:
        found, _, _ = analysed(formula, settings, False)
        out += [(query_id, n, t.term, t.level, t.generalization) for n, t in enumerate(found)]
    return out
