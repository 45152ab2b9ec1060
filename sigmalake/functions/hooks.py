"""What a caller may bring: tree rewrites, payload folds, and formula terms as a table function of SQL.

A ``Rewrite`` takes a normalised tree and gives another; ``Settings(rewrites=...)``
carries it to the workers, so index and search must use the same. A ``Fold``
takes a clause's level and the levels that its term has in a document (arrays of
different ones) and gives the proximity as a Column, 1 at most if ``top_k`` is to
prune; ``Settings(fold=...)`` counts at search only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .mathtree import Node

Rewrite = Callable[[Node], Node]
Fold = Callable[[Column, Column], Column]


def mean_proximity(query_level: Column, levels: Column) -> Column:
    """A fold: the mean of 1 / (1 + distance of levels) over a term's levels in a document, instead of the best."""
    total = F.aggregate(levels, F.lit(0.0), lambda s, x: s + 1 / (1 + F.abs(query_level - x)))
    return total / F.size(levels)


def renamed_operators(names: dict[str, str]) -> Rewrite:
    """A rewrite: operators take other symbols."""
    return _Renamed(tuple(sorted(names.items())))


class _Renamed:
    def __init__(self, names: tuple[tuple[str, str], ...]):
        self.names = dict(names)

    def __call__(self, node: Node) -> Node:
        own = self.names.get(node.name, node.name) if node.kind == "operator" else node.name
        return node._replace(name=own, children=tuple(map(self, node.children)))

    def __eq__(self, other) -> bool:
        return isinstance(other, _Renamed) and self.names == other.names

    def __hash__(self) -> int:
        return hash(tuple(self.names.items()))


def register(spark: SparkSession, name: str = "formula_terms", settings: Settings = DEFAULT, mathml: bool = False) -> None:
    """Registers the table function ``name(formula)`` -> (ord, term, level, generalization): ``... , LATERAL formula_terms(latex)``.

    Null, empty and unreadable formulas give no rows.
    """

    class FormulaTerms:
        def eval(self, formula: str) -> Iterator[tuple]:
            from sigmalake.functions.terms import analysed

            for n, t in enumerate(analysed(formula, settings, mathml)[0] if formula else ()):
                yield n, t.term, t.level, t.generalization

    spark.udtf.register(name, F.udtf(FormulaTerms, returnType="ord int, term string, level int, generalization boolean"))
