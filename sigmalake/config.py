"""Settings of index and search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Switches of the normalisation, the formula cap of the scan (None: no cap), and the weights of the merged score.

    ``rewrites`` follow the normalisation, ``fold`` stands for the payload's
    best proximity: see ``functions.hooks``.
    """

    adjust_tree: bool = True
    reconstruct_expression: bool = True
    reorder_operands: bool = True
    generalise: bool = True
    max_formula_count: int | None = 100_000
    formula_weight: float = 0.7
    page_weight: float = 0.3
    url_prefix: str = "http://en.wikipedia.org/wiki/"
    rewrites: tuple[Callable, ...] = ()
    fold: Callable | None = None


DEFAULT = Settings()
