"""Relevance labels (query, url, relevance) as a table: put, get, delete, list, export; and a store of them.

A store is a commit log over files: a put writes its rows to a file of its own
and commits it, as a whole or not at all, with any number of writers. A later
commit counts before an earlier one; readers see the commits that were there
when they began. From COMPACT parts on they are rewritten as one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import Conflict, Log

SCHEMA = "query string, url string, relevance int"
#: Parts of a store from which a put compacts them, and rows of a compacted file.
COMPACT = 32
FILE_ROWS = 1_000_000


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


class Store:
    """Labels under ``path``. A manifest has ``parts``, oldest first: the names of the folders that hold them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/commits")

    def read(self, manifest: dict | None = None) -> DataFrame:
        """The labels that hold now, or with ``manifest``; an empty store has none."""
        parts = (self.log.latest()[1] if manifest is None else manifest).get("parts", [])
        if not parts:
            return empty(self.spark)
        rows = self.spark.read.schema(SCHEMA + ", part string").option("basePath", self.path).parquet(*[f"{self.path}/part={p}" for p in parts])
        place = F.create_map(*[F.lit(x) for n, p in enumerate(parts) for x in (p, n)])  # a bounded number of parts
        last = F.max_by("relevance", place[F.col("part")]).alias("relevance")
        return rows.groupBy("query", "url").agg(last).where("relevance <> 0")

    def _written(self, changes: DataFrame, rows: int | None = None) -> str:
        name = f"p{uuid.uuid4().hex}"
        own = changes.select("query", "url", F.col("relevance").cast("int").alias("relevance"))
        own = own.coalesce(1) if rows is None else own.repartitionByRange(1 + rows // FILE_ROWS, "query").sortWithinPartitions("query", "url")
        own.write.parquet(f"{self.path}/part={name}")
        return name

    def put(self, changes: DataFrame) -> None:
        """All rows of ``changes`` in one commit; relevance 0 takes a label out. Of rows that repeat a (query, url) the highest counts."""
        one = changes.groupBy("query", "url").agg(F.max("relevance").alias("relevance"))
        part = self._written(one)
        m = self.log.update(lambda m: m | {"parts": [*m.get("parts", []), part]})
        if len(m["parts"]) >= COMPACT:
            self.compact()

    def transact(self, make: Callable[[DataFrame], DataFrame], retries: int = 20) -> None:
        """Puts ``make(labels)``, made of the labels that hold when it is committed: after another's commit it is made again."""
        for _ in range(retries):
            version, m = self.log.latest()
            part = self._written(make(self.read(m)))
            try:
                return self.log.commit(version, m | {"parts": [*m.get("parts", []), part]})
            except Conflict:
                self._drop(part)
        raise Conflict(f"{self.path}: others kept committing")

    def compact(self) -> None:
        """Rewrites the parts of now as one, without what was taken out; parts that come meanwhile stay after it."""
        now = self.log.latest()[1].get("parts", [])
        if len(now) < 2:
            return
        labels = self.read({"parts": now}).persist()
        try:
            base = self._written(labels, labels.count())
        finally:
            labels.unpersist()

        def change(m: dict) -> dict | None:
            return m | {"parts": [base, *m["parts"][len(now) :]]} if m["parts"][: len(now)] == now else None

        if base not in self.log.update(change)["parts"]:
            self._drop(base)  # another compaction was first

    def vacuum(self) -> None:
        """Deletes the parts that the state of now does not name: also a running writer's, and what older readers read."""
        kept = {f"part={p}" for p in self.log.latest()[1].get("parts", [])} | {"commits"}
        for s in self.log.fs.listStatus(self.log._path(self.path)):
            if s.getPath().getName() not in kept:
                self.log.fs.delete(s.getPath(), True)

    def _drop(self, part: str) -> None:
        self.log.fs.delete(self.log._path(f"{self.path}/part={part}"), True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The labels that a store holds now."""
    return Store(spark, path).read()


def store(changes: DataFrame, path: str) -> None:
    """Adds changes (query, url, relevance) to a store in one commit; relevance 0 takes a label out."""
    Store(changes.sparkSession, path).put(changes)


def put(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """``labels`` with each (query, url) of ``changes`` replaced; relevance 0 takes it out. Changes must not repeat a key."""
    old = labels.join(changes.select("query", "url"), ["query", "url"], "left_anti")
    new = changes.where("relevance <> 0")
    return old.select("query", "url", "relevance").unionByName(new.select("query", "url", F.col("relevance").cast("int")))


def delete(labels: DataFrame, keys: DataFrame) -> DataFrame:
    return labels.join(keys.select("query", "url"), ["query", "url"], "left_anti").select("query", "url", "relevance")


def lookup(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (query, url, ...) with ``relevance``, 0 where there is no label."""
    found = pairs.join(labels.select("query", "url", "relevance"), ["query", "url"], "left")
    return found.select(*pairs.columns, F.coalesce("relevance", F.lit(0)).alias("relevance"))


def all_queries(labels: DataFrame) -> DataFrame:
    return labels.select("query").distinct().orderBy("query")


def export(labels: DataFrame) -> DataFrame:
    """(query, labels): per query the JSON array of {url, score}, by url."""
    pair = F.struct("url", F.col("relevance").alias("score"))
    return labels.groupBy("query").agg(F.to_json(F.sort_array(F.collect_list(pair))).alias("labels"))


def export_json(labels: DataFrame) -> str:
    """The whole export as one JSON text, for a label set that fits the caller."""
    rows = export(labels).orderBy("query").toLocalIterator()
    return json.dumps([{"query": r.query, "labels": json.loads(r.labels)} for r in rows], indent=2, ensure_ascii=False)


def write(labels: DataFrame, path: str) -> None:
    """A new store of ``labels``."""
    Store(labels.sparkSession, path).put(labels)
