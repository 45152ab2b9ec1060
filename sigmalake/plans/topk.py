"""The best k pages of a query without scoring all that match.

The index counts the postings of each term and norm: a block. With a query's
weights these bound the score of any document in a block, before a posting is
read. The search goes in three steps, each exact about what it leaves out:

1. a threshold: pages from the highest blocks are scored in full, and the k-th
   best score of theirs is one that the k best pages reach at least;
2. candidates: of each norm the terms are split in two. Documents with none of
   the essential ones score below the threshold whatever else they have, so only
   postings of essential terms are read, and of norms for which no term is
   essential none at all;
3. the candidates' pages are scored in full, as ``search`` does.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.index import Index
from .search import BROADCAST_ROWS, Weighted, search

#: Postings of the highest blocks that the threshold is made from, at least, and pages of theirs.
SEED_POSTINGS, SEED_PAGES = 1_000, 200
#: Pages whose ids reach the scan of the postings as a list.
LISTED_PAGES = 1_000
#: Matching postings beyond which ``worthwhile`` says so: below, all are scored in less time than a threshold takes.
PRUNED_POSTINGS = 2_000_000
#: A score's noise beyond which it counts as lower.
NOISE = 1e-9


@dataclass(frozen=True)
class Bounds:
    """Upper bounds of one query's scores in one kind of index."""

    #: per term: number of its clauses, and the most that they add up to
    terms: dict[str, tuple[int, float]]
    blocks: dict[str, dict[float, int]]
    n_clauses: int
    query_norm: float

    @staticmethod
    def of(q: Weighted, kind: str) -> Bounds:
        rows = q.rows[kind]
        terms = {t: (len(own), sum(c["idf"] ** 2 * c["boost"] for c in own)) for t, own in rows.items()}
        first = next(iter(rows.values()))[0]
        return Bounds(terms, q.blocks[kind], first["n_clauses"], first["query_norm"] or 0.0)

    def score(self, norm: float, terms) -> float:
        """No document of ``norm`` with none but these of the query's terms scores more."""
        own = [self.terms[t] for t in terms]
        return sum(n for n, _ in own) / self.n_clauses * self.query_norm * norm * sum(x for _, x in own)

    def norms(self) -> dict[float, list[str]]:
        """Norms with the terms that have postings of it, highest norm first."""
        out: dict[float, list[str]] = {}
        for t, own in self.blocks.items():
            for norm in own:
                out.setdefault(norm, []).append(t)
        return dict(sorted(out.items(), reverse=True))

    def highest(self) -> float:
        return max((self.score(norm, terms) for norm, terms in self.norms().items()), default=0.0)

    def essential(self, least: float) -> dict[float, list[str]]:
        """Of each norm the terms without one of which no document reaches ``least``; norms without such terms are left out."""
        out = {}
        for norm, terms in self.norms().items():
            rest = sorted(terms, key=lambda t: (self.terms[t][1], t))
            n = 0
            while n < len(rest) and self.score(norm, rest[: n + 1]) < least:
                n += 1
            if rest[n:]:
                out[norm] = sorted(rest[n:])
        return out

    def postings(self, essential: dict[float, list[str]]) -> int:
        return sum(self.blocks[t][norm] for norm, terms in essential.items() for t in terms)


def _in_blocks(essential: dict[float, list[str]]):
    """A condition on postings: those of these norms and terms. Norms are exact binary fractions."""
    parts = [(F.col("norm") == F.lit(norm)) & F.col("term").isin(terms) for norm, terms in essential.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _restricted(index: Index, keep) -> Index:
    return replace(index, postings={k: keep(p) for k, p in index.postings.items()})


def _seeds(index: Index, bounds: Bounds) -> list[int]:
    """Ids of at most SEED_PAGES pages from the blocks in which one term alone may score most."""
    blocks = sorted(((bounds.score(norm, [t]), norm, t) for t, own in bounds.blocks.items() for norm in own), key=lambda b: (-b[0], b[2]))
    wanted, n = {}, 0
    for _, norm, t in blocks:
        wanted.setdefault(norm, []).append(t)
        n += bounds.blocks[t][norm]
        if n >= SEED_POSTINGS:
            break
    found = index.postings["formula"].where(_in_blocks(wanted)).select("page_id").limit(SEED_POSTINGS).distinct().limit(SEED_PAGES)
    return [r.page_id for r in found.collect()]


def candidates(index: Index, q: Weighted, k: int, settings: Settings = DEFAULT) -> DataFrame | None:
    """(page_id): every page that may be among the best k, from the postings of essential terms; None where nothing can be left out."""
    formula, page = Bounds.of(q, "formula"), Bounds.of(q, "page")
    seeds = _seeds(index, formula)
    best = search(_restricted(index, lambda p: p.where(F.col("page_id").isin(seeds))), q, settings).select("score").orderBy(F.desc("score")).limit(k).collect()
    if len(best) < k or settings.formula_weight <= 0 or settings.page_weight < 0:
        return None
    # a page's merged score is bounded by its best formula's, and the highest a page can have
    least = (best[-1].score - NOISE - settings.page_weight * page.highest()) / settings.formula_weight
    essential = formula.essential(least)
    if formula.postings(essential) == formula.postings(formula.norms()) or not essential:
        return None
    return index.postings["formula"].where(_in_blocks(essential)).select("page_id").distinct()


def top_k(index: Index, q: Weighted, k: int, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of ``search`` with all of the best ``k`` pages of one query among them, ties too; many others are left out.

    ``index`` and ``q`` are what ``prepared`` makes of one query. The rest of
    the work grows with the candidates, not with the pages that match.
    """
    if settings.fold or not any(q.rows["formula"].values()):  # a caller's fold has no bound that is known
        return search(index, q, settings)
    pages = candidates(index, q, k, settings)
    if pages is None:
        return search(index, q, settings)
    pages = pages.persist()
    try:
        n = pages.count()
        if n <= LISTED_PAGES:  # the ids reach the scan, which skips what has none of them
            own = [r.page_id for r in pages.collect()]
            return search(_restricted(index, lambda p: p.where(F.col("page_id").isin(own))), q, settings)
    finally:
        pages.unpersist()
    near = F.broadcast(pages) if n <= BROADCAST_ROWS else pages
    return search(_restricted(index, lambda p: p.join(near, "page_id", "left_semi")), q, settings)


def worthwhile(q: Weighted) -> bool:
    """Whether so many postings match that a threshold is likely to pay for its jobs."""
    return sum(sum(own.values()) for own in q.blocks["formula"].values()) > PRUNED_POSTINGS


def total_hits(index: Index, q: Weighted) -> int:
    """Pages that match: those of any of the query's terms. Only terms and ids are read; one term's are counted already."""
    own = [t for t in q.blocks["page"] if q.blocks["page"][t]]
    if len(own) < 2:
        return sum(sum(q.blocks["page"][t].values()) for t in own)
    return index.postings["page"].select("page_id").distinct().count()
