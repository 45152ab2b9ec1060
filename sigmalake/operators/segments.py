"""An index that grows: immutable segments under a manifest, searched together and merged.

Every append writes the indexes of its pages as a segment of its own, with its
own df, sizes and norms, and commits it. A page that an older segment has is
replaced: the commit names it as dead there and carries the corrections of df
and sizes that follow, so that a search over segments scores like one over an
index built at once. Merging rewrites the live rows of segments as one, in the
order of terms. Readers keep the state that they opened; writers may be several.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import DEFAULT, Settings
from ..functions import scoring
from ..sources import wiki
from . import index as index_tables
from .commits import Log
from .index import KINDS, Index

#: Dead pages up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Segments from which ``ingest`` merges them after a batch.
MOST_SEGMENTS = 10


class Segments:
    """The segments under ``path``.

    A manifest has ``segments`` (names), ``fixes`` (names of the folders with
    dead pages and corrections) and their number of ``dead`` pages, and
    ``batches``: the last batch of each stream that is in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/manifests")

    # --- reading ---

    def _tables(self, segments: list[str], name: str) -> DataFrame:
        """A table of several segments in one scan, with ``segment`` from the folders' names."""
        paths = [f"{self.path}/segment={s}/{name}" for s in segments]
        return self.spark.read.option("basePath", self.path).parquet(*paths).withColumn("segment", F.col("segment").cast("string"))

    def _fixes(self, fixes: list[str], name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/fix-{f}/{name}" for f in fixes])

    def _live(self, table: DataFrame, manifest: dict) -> DataFrame:
        """The rows whose page is not dead in its segment."""
        if not manifest.get("dead"):
            return table
        dead = self._fixes(manifest["fixes"], "dead")
        dead = F.broadcast(dead) if manifest["dead"] <= BROADCAST_ROWS else dead
        return table.join(dead, ["page_id", "segment"], "left_anti")

    def open(self, manifest: dict | None = None) -> Index:
        """The index of all live pages; ValueError if there are none yet."""
        m = self.log.latest()[1] if manifest is None else manifest
        own = m.get("segments", [])
        if not own:
            raise ValueError(f"no segments in {self.path}")
        some = bool(m.get("dead"))

        def live(name: str) -> DataFrame:
            return self._live(self._tables(own, name), m).drop("segment")

        def summed(name: str, by: list[str], count: str) -> DataFrame:
            t = self._tables(own, name).select(*by, count)
            if some:
                t = t.unionByName(self._fixes(m["fixes"], name))
            t = t.groupBy(*by).agg(F.sum(count).alias(count))
            return t.where(F.col(count) > 0) if by else t

        known = live("known")
        lengths = {
            "formula": known.select(F.col("formula_id").alias("doc_id"), F.col("n_terms").cast("long").alias("len")),
            "page": self._live(self._tables(own, "docs_page").withColumn("page_id", F.col("doc_id")), m).select("doc_id", "len"),
        }
        return Index(
            live("pages"), live("formulas"), known, {k: live(f"postings_{k}") for k in KINDS},
            {k: v.select("doc_id", "len", scoring.norm(F.col("len")).alias("norm")) for k, v in lengths.items()},
            {k: summed(f"blocks_{k}", ["term", "norm"], "n") for k in KINDS}, {k: summed(f"sizes_{k}", [], "n_docs") for k in KINDS},
        )

    # --- writing ---

    def _fix(self, manifest: dict, segment: str) -> tuple[str, int]:
        """Writes what replacing pages of ``manifest`` by those of ``segment`` makes dead: (name, number of pages)."""
        name = uuid.uuid4().hex
        root = f"{self.path}/fix-{name}"
        old = self._live(self._tables(manifest["segments"], "pages"), manifest)
        new = self.spark.read.parquet(f"{self.path}/segment={segment}/pages").select("page_id")
        old.join(new, "page_id", "left_semi").select("page_id", "segment").write.parquet(f"{root}/dead")
        dead = self.spark.read.parquet(f"{root}/dead")
        n = dead.count()
        near = F.broadcast(dead) if n <= BROADCAST_ROWS else dead
        for kind in KINDS if n else ():
            gone = self._tables(manifest["segments"], f"postings_{kind}").join(near, ["page_id", "segment"], "left_semi")
            gone.groupBy("term", "norm").agg((-F.count("*")).alias("n")).write.parquet(f"{root}/blocks_{kind}")
            lost = dead if kind == "page" else self._tables(manifest["segments"], "known").join(near, ["page_id", "segment"], "left_semi")
            lost.agg((-F.count("*")).alias("n_docs")).write.parquet(f"{root}/sizes_{kind}")
        return name, n

    def append(self, pages: DataFrame, formulas: DataFrame, settings: Settings = DEFAULT, batch: tuple[str, int] | None = None) -> bool:
        """Adds pages (page_id, title) with their formulas (formula_id, page_id, latex, ...); pages known already are replaced whole.

        Formulas of other pages must not be among them, nor a page twice. With
        ``batch`` (a stream and its batch) a batch that is in already is not
        added again: False.
        """
        if batch and self.log.latest()[1].get("batches", {}).get(batch[0], -1) >= batch[1]:
            return False
        segment = f"s{uuid.uuid4().hex}"
        index_tables.write(index_tables.build(pages, formulas, settings), f"{self.path}/segment={segment}")

        def change(m: dict) -> dict | None:
            if batch:
                if m.get("batches", {}).get(batch[0], -1) >= batch[1]:
                    return None
                m["batches"] = m.get("batches", {}) | {batch[0]: batch[1]}
            own = m.get("segments", [])
            fix, dead = self._fix(m, segment) if own else ("", 0)
            if dead:
                m |= {"fixes": [*m.get("fixes", []), fix], "dead": m.get("dead", 0) + dead}
            return m | {"segments": [*own, segment]}

        return segment in self.log.update(change)["segments"]

    def merge(self) -> bool:
        """Rewrites all segments of now as one, without the dead rows; False if there is nothing to merge.

        Segments that others append meanwhile stay beside it. If one of them
        replaces pages of what is being merged, the merge is made again.
        """
        for _ in range(8):
            now = self.log.latest()[1]
            own = now.get("segments", [])
            if len(own) < 2:
                return False
            segment = f"s{uuid.uuid4().hex}"
            index_tables.rewrite(self.open(now), f"{self.path}/segment={segment}")

            def change(m: dict) -> dict | None:
                if m.get("fixes", []) != now.get("fixes", []) or not set(own) <= set(m["segments"]):
                    return None
                return m | {"segments": [segment, *(s for s in m["segments"] if s not in own)], "fixes": [], "dead": 0}

            if segment in self.log.update(change)["segments"]:
                return True
        raise RuntimeError("pages under merge keep being replaced")

    def vacuum(self) -> list[str]:
        """Deletes the folders that the state of now does not name (also a running writer's); their names."""
        m = self.log.latest()[1]
        kept = {"manifests", *(f"segment={s}" for s in m.get("segments", [])), *(f"fix-{f}" for f in m.get("fixes", []))}
        folders = [s.getPath() for s in self.log.fs.listStatus(self.log._path(self.path))]
        old = [p for p in folders if p.getName() not in kept]
        for p in old:
            self.log.fs.delete(p, True)
        return sorted(p.getName() for p in old)


def with_ids(pages: DataFrame) -> DataFrame:
    """(formula_id, page_id, pos, latex, doc_title) of pages (page_id, title, text).

    Ids follow (page_id, pos) and depend on nothing else, so that a page has the
    same ones in whichever batch it comes: page_id x 2^20 + pos.
    """
    each = wiki.with_formulas(pages).select("page_id", F.posexplode("mathes").alias("pos", "latex"), F.col("title").alias("doc_title"))
    place = F.when(F.col("pos") < 1 << 20, F.col("pos")).otherwise(F.raise_error(F.lit("over 2^20 formulas in a page")).cast("int"))
    return each.select((F.col("page_id") * (1 << 20) + place).alias("formula_id"), "page_id", "pos", "latex", "doc_title")


def ingest(pages: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULT, most: int = MOST_SEGMENTS, name: str = "pages") -> StreamingQuery:
    """Streamed pages (page_id, title, text) into the segments under ``path``: one a batch, merged from ``most`` on.

    A batch that Spark runs again after a failure is added once: the manifest
    that adds a segment also names its batch. Of a page's rows in a batch one
    with the greatest text counts.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        own = Segments(batch.sparkSession, path)
        one = batch.groupBy("page_id").agg(F.max(F.struct("text", "title")).alias("p")).select("page_id", "p.title", "p.text").persist()
        try:
            if not one.isEmpty():
                own.append(one, with_ids(one), settings, (name, batch_id))
        finally:
            one.unpersist()
        if len(own.log.latest()[1].get("segments", [])) >= most:
            own.merge()

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

