"""The two inverted indexes over formula terms: one document per formula, one per page."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import scoring
from ..functions.terms import analyse_folded
from .progress import observed

KINDS = ("formula", "page")
KNOWN = ("formula_id", "page_id", "folded", "n_terms", "is_error")


#: Rows of a written partition: of the first SMALL_PARTITIONS, so that a small table is read by several tasks, and of all beyond.
SMALL_ROWS, SMALL_PARTITIONS = 20_000, 32
PARTITION_ROWS = 1_000_000


def _partitions(rows: int) -> int:
    return 1 + min(rows // SMALL_ROWS, SMALL_PARTITIONS) + rows // PARTITION_ROWS


@dataclass(frozen=True)
class Index:
    """The analysed formulas (known), and what follows from them.

    For each kind postings (term, doc_id, page_id, levels, norm), docs (doc_id,
    len, norm), blocks (term, norm, n: the postings of a term and norm), and
    sizes (n_docs: one row); and the attributes of pages and formulas.
    """

    pages: DataFrame
    formulas: DataFrame
    known: DataFrame
    postings: dict[str, DataFrame]
    docs: dict[str, DataFrame]
    blocks: dict[str, DataFrame]
    sizes: dict[str, DataFrame]

    @property
    def term_stats(self) -> dict[str, DataFrame]:
        """(term, df) of each kind."""
        return {k: b.groupBy("term").agg(F.sum("n").alias("df")) for k, b in self.blocks.items()}


def analysed(formulas: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Formulas with their terms once each (folded: term, levels), n_terms and is_error: the only pass in Python."""
    a = formulas.select("*", analyse_folded(F.col("latex"), settings).alias("_a"))
    return a.select(*formulas.columns, F.col("_a.folded").alias("folded"), "_a.n_terms", "_a.is_error")


def build(pages: DataFrame, formulas: DataFrame, settings: Settings = DEFAULT) -> Index:
    """Indexes over pages (page_id, title) and formulas (formula_id, page_id, latex, doc_title)."""
    return of_known(pages, formulas, analysed(formulas, settings).select(*KNOWN))


def of_known(pages: DataFrame, formulas: DataFrame, known: DataFrame) -> Index:
    """Indexes over analysed formulas.

    A formula's row has its terms once each, so its postings need no shuffle; a
    page's are the union of its formulas'. Postings carry the norm of their
    document, so that a search reads nothing else. Documents without terms stay
    in ``docs`` and count in n_docs.
    """
    each = known.select(F.col("formula_id").alias("doc_id"), "page_id", scoring.norm(F.col("n_terms")).alias("norm"), F.explode("folded").alias("t"))
    by_formula = each.select("doc_id", "page_id", "t.term", "t.levels", "norm")
    levels = F.sort_array(F.array_distinct(F.flatten(F.collect_set("levels")))).alias("levels")
    length = known.groupBy("page_id").agg(F.sum("n_terms").alias("len"))
    by_page = by_formula.groupBy("page_id", "term").agg(levels).join(length, "page_id")
    by_page = by_page.select(F.col("page_id").alias("doc_id"), "page_id", "term", "levels", scoring.norm(F.col("len")).alias("norm"))
    lengths = {
        "formula": known.select(F.col("formula_id").alias("doc_id"), F.col("n_terms").cast("long").alias("len")),
        "page": pages.select("page_id").join(length, "page_id", "left").select(F.col("page_id").alias("doc_id"), F.coalesce("len", F.lit(0)).cast("long").alias("len")),
    }
    postings = {"formula": by_formula, "page": by_page}
    return Index(
        pages.select("page_id", "title"), formulas, known, postings,
        {k: v.select("doc_id", "len", scoring.norm(F.col("len")).alias("norm")) for k, v in lengths.items()},
        {k: v.groupBy("term", "norm").agg(F.count("*").alias("n")) for k, v in postings.items()},
        {"formula": known.agg(F.count("*").alias("n_docs")), "page": pages.agg(F.count("*").alias("n_docs"))},
    )


def counters(formulas: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(formulas, errors, terms): one row. Every formula is read once, so an error counts once."""
    return counted(analysed(formulas, settings))


def counted(known: DataFrame) -> DataFrame:
    """(formulas, errors, terms) of analysed formulas."""
    return known.agg(*[c.alias(name) for name, c in _counters().items()])


def _counters() -> dict:
    return {
        "formulas": F.count("*"),
        "errors": F.coalesce(F.sum(F.col("is_error").cast("long")), F.lit(0)),
        "terms": F.coalesce(F.sum("n_terms"), F.lit(0)),
    }


def write(index: Index, path: str) -> dict[str, int]:
    """Parquet tables under ``path``, which must not exist; returns what ``counted`` counts, seen by the pass that analyses.

    Formulas are analysed in one pass; everything else is made of its table.
    """
    known, seen = observed(index.known, **_counters())
    known.write.parquet(f"{path}/known")
    known = index.pages.sparkSession.read.parquet(f"{path}/known")
    _write_tables(of_known(index.pages, index.formulas, known), path)
    return seen.get


def rewrite(index: Index, path: str) -> None:
    """``write`` of an index whose tables are there already: nothing is analysed or grouped again."""
    index.known.write.parquet(f"{path}/known")
    _write_tables(replace(index, known=index.pages.sparkSession.read.parquet(f"{path}/known")), path)


def _write_tables(own: Index, path: str) -> None:
    """All but ``known``.

    Postings lie by term and falling norm, so that a term is found by its row
    groups, and those of its documents that may score high by the first of them;
    the attributes lie in the order of their ids. Partitions follow the rows.
    """
    spark = own.pages.sparkSession
    for name, table, by in (("pages", own.pages, "page_id"), ("formulas", own.formulas, "formula_id")):
        table.repartitionByRange(_partitions(table.count()), by).sortWithinPartitions(by).write.parquet(f"{path}/{name}")
    rows = own.known.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]
    parts = _partitions(rows)
    order = ("term", F.desc("norm"), "doc_id")
    for kind in KINDS:
        ordered = own.postings[kind].repartitionByRange(parts, *order).sortWithinPartitions(*order)
        ordered.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings_{kind}")
        own.docs[kind].write.parquet(f"{path}/docs_{kind}")
        blocks = spark.read.parquet(f"{path}/postings_{kind}").groupBy("term", "norm").agg(F.count("*").alias("n"))
        blocks.repartitionByRange(_partitions(rows // 8), "term").sortWithinPartitions("term").write.parquet(f"{path}/blocks_{kind}")
        own.sizes[kind].coalesce(1).write.parquet(f"{path}/sizes_{kind}")


def read(spark: SparkSession, path: str) -> Index:
    def load(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    each = lambda name: {k: load(f"{name}_{k}") for k in KINDS}
    return Index(load("pages"), load("formulas"), load("known"), each("postings"), each("docs"), each("blocks"), each("sizes"))


def opened(index: Index) -> Index:
    """``index`` with all that searches read kept in memory (and on disk beyond it), filled now."""
    for d in (index.pages, index.formulas, *index.postings.values(), *index.blocks.values(), *index.sizes.values()):
        d.cache().count()
    return index
