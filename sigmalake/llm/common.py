"""Shared pieces of the training-data operators: word rules, folds, scratch tables, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import written

#: A word is a run of anything but ASCII white space (Java and Python regex alike).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Array of words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            deleted(df.sparkSession, name.rpartition("/")[0])


#: Bytes up to which a side of a join may be broadcast, by ``small``.
BROADCAST_BYTES = 48_000_000


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` marked for broadcast if its counted rows come to at most BROADCAST_BYTES, else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over ``edges`` (a, b), for every node on an edge.

    Large-star and small-star steps in turn, each one shuffle on a node with
    map-side pre-aggregation of the minima, until nothing changes. Every round
    is written to the shared folder, which also cuts the lineage, and the one
    before it deleted. Null ends are dropped; an empty input gives an empty
    result.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where("a is not null and b is not null")
    ids = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    e = ids
    for _ in range(rounds):
        both = e.where("a <> b").select("a", "b").union(e.where("a <> b").select(F.col("b"), F.col("a")))
        # as a table, so that the join below shuffles both sides and AQE may split the rows of a hub
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links")
        # large star: every larger neighbour of a points to a's minimum
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours point to the smallest
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = written(small, "links")
        dropped(least, *[e] * (e is not ids))
        e = new
        # settled: every node points to one other, which points to none
        several = e.groupBy("a").count().where("count > 1").select("a")
        chained = e.select(F.col("b").alias("a")).join(e, "a", "left_semi")
        if several.union(chained).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).union(
        ids.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))


def arrow_rows(spark: SparkSession, rows: int = 2_000) -> None:
    """Sets how many rows an Arrow batch may hold. Texts are long: at Spark's 10,000 a batch, and the JVM's copies of it, take over 100 MB a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
