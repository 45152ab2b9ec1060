"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors of one label are bucketed in several tables, each by
quantised random projections; members of a bucket are compared by exact cosine
in double precision. A pair that meets in several tables counts in the first
only, so links are counted without listing pairs. Equal vectors are one, with
their number as its weight. The number of projections
follows the number of vectors, which keeps chance collisions rare at any size,
and the number of tables follows from the recall asked for. Only vectors that
share a bucket ever travel; a large bucket is split into a grid of parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table, written

COSINE = 0.98
RECALL = 0.995
#: Width of the quantisation, on vectors of length 1.
WIDTH = 1.0
SEED = 11
#: Rows that a task compares, and members of a bucket from which it is split.
TASK_ROWS = 20_000
PART = 4_000


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two vectors at this distance into the same cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections per table, tables) for ``n`` vectors: under 0.05 chance neighbours a table, and the recall at the threshold."""
    far, near = collision(1.25), collision(math.sqrt(2 - 2 * cosine))
    k = max(4, math.ceil(math.log(max(n, 2) / 0.05) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


class Tables:
    """The random projections; the same seed, size and dimension give the same."""

    def __init__(self, dim: int, k: int, tables: int, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, k, tables])
        self.a = rng.standard_normal((dim, tables * k))
        self.b = rng.uniform(0, WIDTH, tables * k)
        self.mix = rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) * 2 + 1
        self.add = rng.integers(1, 1 << 62, tables, dtype=np.int64)
        self.k, self.tables = k, tables

    def keys(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(vector, table) 64-bit keys; different labels, dimensions and tables have different keys."""
        cell = np.floor((unit @ self.a + self.b) / WIDTH).astype(np.int64).reshape(len(unit), self.tables, self.k)
        with np.errstate(over="ignore"):
            h = (cell * self.mix).sum(axis=2) + self.add + label.astype(np.int64)[:, None] * np.int64(0x1E3779B97F4A7C15) + unit.shape[1]
            h ^= h >> np.int64(31)
            h *= np.int64(0x3F58476D1CE4E5B9)
        return h


def _matrix(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each dimension in an array column without nulls inside."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    at = np.cumsum(size) - size
    return [(rows := np.flatnonzero(size == d), flat[at[rows][:, None] + np.arange(d)]) for d in np.unique(size).tolist()]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keyed(k: int, tables: int):
    def run(batches):
        for b in batches:
            uid, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            for rows, v in _matrix(b.column(2)):
                key = Tables(v.shape[1], k, tables).keys(_unit(v), label[rows])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(uid[rows], tables))], names=["key", "uid"])

    return run


def _linked(unit: np.ndarray, weight: np.ndarray, keys: np.ndarray, own: int, part: np.ndarray, cell: tuple[int, int], cosine: float):
    """Per member of a bucket cell: weight of links first met here, and a member that it is connected with (itself: none)."""
    n = len(unit)
    count, root = np.zeros(n), np.arange(n)
    rows = max(1, (1 << 21) // n)
    for at in range(0, n, rows):
        near = unit[at : at + rows] @ unit.T >= cosine
        i, j = np.nonzero(near)
        i += at
        ok = i < j
        if cell[0] != cell[1]:
            ok &= part[i] != part[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        # trees: of two roots that a link joins the larger hangs on the smaller, until no link joins two
        x, y = root[i], root[j]
        while len(x := x[some := x != y]):
            y = y[some]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            x, y = root[x], root[y]
        met = np.zeros(len(i), bool)
        for t in range(own):
            met |= keys[i, t] == keys[j, t]
        i, j = i[~met], j[~met]
        count += np.bincount(i, weight[j], minlength=n) + np.bincount(j, weight[i], minlength=n)
    return count.astype(np.int64), root


def _compared(k: int, tables: int, cosine: float):
    def run(t: pa.Table) -> pa.Table:
        uid, key, label, weight = (t.column(c).to_numpy() for c in ("uid", "key", "label", "weight"))
        x, y, part = (t.column(c).to_numpy() for c in ("x", "y", "part"))
        out: list[tuple] = []
        for rows, v in _matrix(t.column("embedding")):
            unit = _unit(v)
            all_keys = Tables(v.shape[1], k, tables).keys(unit, label[rows])
            order = np.lexsort((uid[rows], y[rows], x[rows], key[rows]))
            s = rows[order]
            cuts = np.flatnonzero((np.diff(key[s]) != 0) | (np.diff(x[s]) != 0) | (np.diff(y[s]) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)]):
                if b - a < 2:
                    continue
                o, r = order[a:b], s[a:b]
                own = int(np.flatnonzero(all_keys[o[0]] == key[r[0]])[0])
                count, root = _linked(unit[o], weight[r], all_keys[o], own, part[r], (x[r[0]], y[r[0]]), cosine)
                some = (count > 0) | (root != np.arange(len(r)))
                out.append((uid[r][some], count[some], uid[r][root][some]))
        c = [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"uid": c[0], "n": c[1], "other": c[2]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and the cosine reaches the
    threshold; no pair below it links, pairs above it are met with a chance of
    ``recall`` or more. Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without a label, link with nothing and are
    their own component. Rows that repeat an id are vectors of their own. A
    null id is never a component's id while another is reachable, and not kept.
    An empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good &= F.forall(v, fine) & F.exists(v, lambda x: x != 0)
    rows = written(
        vectors.select(
            F.col(id_col).alias("id"), F.xxhash64(F.col(label_col).cast("string")).alias("label"),
            F.col(vector_col).alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"),
        ).withColumn("uid", F.monotonically_increasing_id()),
        "vectors",
    )
    equal = rows.where("good").groupBy("label", "embedding").agg(F.min("uid").alias("uid"), F.count("*").alias("weight"), F.min("id").alias("least"))
    valid = written(equal, "vectors")  # one row for equal vectors
    most = valid.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k, tables = plan(most, cosine, recall)
    keys = written(valid.select("uid", "label", "embedding").mapInArrow(_keyed(k, tables), "key long, uid long"), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / PART).cast("int")
    met = keys.join(shared, "key").select("key", "uid", F.when(F.col("m") > PART, parts).otherwise(1).alias("p"))
    met = met.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("p")).cast("int"))
    # a member of part a goes to the cells (a, b) of all parts b
    met = met.select("key", "uid", "part", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("with"))
    met = met.select("key", "uid", "part", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"))
    met = written(met, "met")
    buckets = met.count() // TASK_ROWS + 1
    bucket = F.pmod(F.xxhash64("key", "x", "y"), F.lit(buckets)).cast("int").alias("bucket")
    vectors = valid.select("uid", "label", "embedding", "weight")
    found = met.join(vectors, "uid").groupBy(bucket).applyInArrow(_compared(k, tables, cosine), "uid long, n long, other long")
    found = written(found, "links")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n_links"))
    tree = components(found.where("uid <> other").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    root = valid.select("uid", "least", "weight").join(tree, F.col("uid") == F.col("node"), "left")
    root = root.select("uid", "least", "weight", F.coalesce("component", "uid").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("least"))
    of = root.drop("least").join(least, "root").join(counts, "uid", "left")
    of = of.select("uid", "least", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # a row's vector is one of ``valid``; the other rows link with nothing
    known = valid.select("label", "embedding", F.col("uid").alias("of")).join(of.withColumnRenamed("uid", "of"), "of")
    good = rows.where("good").select("id", "label", "embedding").join(known.drop("of"), ["label", "embedding"]).select("id", "n_links", "least")
    out = good.unionByName(rows.where("not good").select("id", F.lit(0).alias("n_links"), F.col("id").alias("least")))
    component = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
