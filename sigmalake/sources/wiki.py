"""Pages and formulas: MediaWiki dumps, formula extraction, ids and the formula cap."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.macros import expanded
from ..operators.progress import observed
from ..operators.scratch import written

#: Fixed value: what a formula is in wiki text.
MATH = r"(?s)<math>(.*?)</math>"
#: A text as one string: markup that is not escaped in it stays as it is written, comments go; as a struct, the text before them would be lost.
PAGE_SCHEMA = "title string, id long, revision struct<text: string>"
#: Ranges into which numbering deals its rows: at least, and rows of one beyond.
RANGES = 8
RANGE_ROWS = 1_000_000
#: Bytes of the first wave of files that ``scan_until`` reads; each next one may take twice as many.
WAVE_BYTES = 256_000_000


def _own(df: DataFrame, *names: str) -> list[str]:
    """Names of columns that are longer than any of the table's."""
    return ["_" * (1 + max(map(len, df.columns), default=0)) + n for n in names]


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with its own ``part``, a range of the ordering columns that rises with them, and ``row``, the place in it: written once."""
    part, row = _own(df, "part", "row")
    dealt = df.repartitionByRange(RANGES + df.count() // RANGE_ROWS, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition's number, then 33 bits of the row's
    d = written(dealt.withColumn(row, place), "ranges")
    return d.withColumn(part, F.shiftright(row, 33)).withColumn(row, F.col(row).bitwiseAND(F.lit((1 << 33) - 1)))


def _before(d: DataFrame, n: Column, part: str, before: str) -> DataFrame:
    """(part, before): what the ranges before each come to."""
    sums = d.groupBy(part).agg(n.alias("n"))  # a row for each range
    return F.broadcast(sums.select(part, (F.sum("n").over(W.orderBy(part)) - F.col("n")).alias(before)))


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(page_id, title, text) of a MediaWiki XML export, split over tasks by the XML reader. The schema is never inferred."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)
    return raw.select(F.col("id").alias("page_id"), "title", F.col("revision.text").alias("text"))


def extract(text: Column, pattern: str = MATH) -> Column:
    """All formulas of a text in order, repeats kept; null or none: empty."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), 1), F.array().cast("array<string>"))


def with_formulas(pages: DataFrame, macros: bool = True) -> DataFrame:
    """``pages`` with ``mathes``, the array of their formulas; what a page defines is expanded in its formulas."""
    found = extract(F.col("text"))
    return pages.withColumn("mathes", expanded(found) if macros else found)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... in the given order, without bringing all rows into one task.

    Rows are sorted in ranges of the ordering columns; a range's rows are
    numbered on their own and shifted by the counts of the ranges before it.
    Ties in ``order`` must be equal rows or the numbers among them are arbitrary.
    """
    part, row, before = _own(df, "part", "row", "before")
    d = _ranged(df, order)
    d = d.join(_before(d, F.count("*"), part, before), part)
    return d.select(*df.columns, (F.col(before) + F.col(row) + 1).cast("long").alias(name))


def capped(pages: DataFrame, limit: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Pages (page_id, n_formulas, ...) up to and with the one that brings the formulas to ``limit``, in the order of page_id.

    Running sums within ranges of page_id, shifted by the sums of the ranges
    before. Without a limit here, that of the settings; without any, all pages.
    """
    limit = settings.max_formula_count if limit is None else limit
    if limit is None:
        return pages
    part, row, before, running = _own(pages, "part", "row", "before", "running")
    d = _ranged(pages, ["page_id"])
    frame = W.partitionBy(part).orderBy(row).rowsBetween(W.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("n_formulas").over(frame), F.lit(0))
    d = d.withColumn(running, so_far).join(_before(d, F.sum("n_formulas"), part, before), part)
    return d.where(F.col(before) + F.col(running) < limit).select(pages.columns)


def dump_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a dump's files in the order of their names, numbers in them by value."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(root) if s.isFile()]
    shown = [f for f in found if not f[0].rsplit("/", 1)[-1].startswith(("_", "."))]
    return sorted(shown, key=lambda f: [int(x) if x.isdigit() else x for x in re.split("([0-9]+)", f[0].rsplit("/", 1)[-1])])


def scan_until(spark: SparkSession, path: str, limit: int, wave_bytes: int = WAVE_BYTES, macros: bool = True) -> tuple[DataFrame, list[str]]:
    """(pages up to and with the one that brings the formulas to ``limit``, files that were read).

    The files of a dump are read in growing waves, in the order of their names,
    each wave written once and counted as it is written; what lies after the
    wave that reaches the limit is never opened. Pages have page_id, title,
    mathes and n_formulas. Where the files' pages follow one another by id, as in
    a dump's numbered parts, these are the pages that ``capped`` keeps of the
    whole dump. A file is the least that is read.
    """
    rest, read, waves, total = dump_files(spark, path), [], [], 0
    while rest and total < limit:
        wave = [rest.pop(0)]
        while rest and sum(b for _, b in wave) + rest[0][1] <= wave_bytes:
            wave.append(rest.pop(0))
        names = [f for f, _ in wave]
        pages = with_formulas(read_dump(spark, names), macros).select("page_id", "title", "mathes", F.size("mathes").alias("n_formulas"))
        pages, seen = observed(pages, n=F.coalesce(F.sum("n_formulas"), F.lit(0)))
        waves.append(written(pages, "scan"))
        total, read, wave_bytes = total + seen.get["n"], read + names, 2 * wave_bytes
    if not waves:
        return spark.createDataFrame([], "page_id long, title string, mathes array<string>, n_formulas int"), read
    return capped(reduce(DataFrame.union, waves), limit), read


def formulas(pages: DataFrame) -> DataFrame:
    """(formula_id, page_id, pos, latex, doc_title) of pages (page_id, title, mathes); ids follow (page_id, pos)."""
    each = pages.select("page_id", F.posexplode("mathes").alias("pos", "latex"), F.col("title").alias("doc_title"))
    return numbered(each, ["page_id", "pos"], "formula_id").select("formula_id", "page_id", "pos", "latex", "doc_title")
