"""Vector codes by Hamerly's version of Lloyd's rounds, in whole numbers.

Components become integers, vectors are cut into equal parts, and each part
position has a codebook. With each part stay its entry, an upper bound of the
distance to it and a lower bound of that to the second nearest one. When
entries move, the bounds move with them; a part is measured against all
entries only where the upper bound does not stay strictly under the lower one,
so equal distances are always measured, and go to the lower index.

A round is one job: it writes the parts' new state and, as rows of the same
table, what each task's parts add to the entries' sums. Only parts that changed
their entry add anything. The driver sees the summed entries alone, some
entries x dimension numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, small, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds are doubles of exact integer distances; they are widened by more than a rounding.
SLACK = 1e-12
#: Numbers that a batch's distances may take while they are measured.
MEASURED = 1 << 22

STATE = "ints array<int>, entry array<int>, upper array<double>, lower array<double>, place array<int>, moved array<long>"


def limit_of(dim: int) -> int:
    """The largest power of two whose differences, squared and summed over ``dim`` components, fit a long; at most 2^30."""
    k = 30
    while k > 0 and max(dim, 1) * (1 << (2 * k + 2)) >= 1 << 63:
        k -= 1
    return 1 << k


def fine(v: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & ok, F.lit(False))


def integers(v: Column, dim: int, scale: int = SCALE) -> Column:
    """floor(scale * x) of the components, cut at +-limit_of(dim); zeros follow up to ``dim``."""
    most = float(limit_of(dim))
    each = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x * F.lit(float(scale))))).cast("int"))
    return F.concat(each, F.array_repeat(F.lit(0), F.lit(dim) - F.size(v)))


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(parts, entries) squared distances of (parts, width) integers to (entries, width) ones, exactly."""
    out = np.empty((len(parts), len(book)), np.int64)
    rows = max(1, MEASURED // max(1, book.size))
    for a in range(0, len(parts), rows):
        d = parts[a : a + rows, None, :] - book[None, :, :]
        out[a : a + rows] = np.einsum("new,new->ne", d, d)
    return out


def scan(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) by measuring every entry; of equal ones the lower index."""
    d = distances(parts, book)
    entry = d.argmin(axis=1).astype(np.int32)
    own = d[np.arange(len(d)), entry]
    d[np.arange(len(d)), entry] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(float)) * (1 - SLACK) if len(book) > 1 else np.full(len(d), 1e300)
    return entry, np.sqrt(own.astype(float)) * (1 + SLACK), lower


def reassigned(parts: np.ndarray, entry, upper, lower, book: np.ndarray, moved: np.ndarray, half: np.ndarray):
    """The state of one position's parts after its entries moved by ``moved``; ``half``: of each entry's distance to the next one.

    Returns (entry, upper, lower, number of parts measured against all entries).
    """
    order = np.argsort(-moved, kind="stable")
    first, second = (moved[order[0]], moved[order[1]]) if len(moved) > 1 else (0.0, 0.0)
    upper = (upper + moved[entry]) * (1 + SLACK)
    # a difference loses more than its own rounding: what it was taken from counts
    lower = lower - np.where(entry == order[0], second, first) - SLACK * (np.abs(lower) + first)
    safe = np.maximum(lower, half[entry])
    doubt = np.flatnonzero(~(upper < safe))
    if len(doubt):  # the upper bound made exact
        d = parts[doubt] - book[entry[doubt]]
        upper[doubt] = np.sqrt(np.einsum("nw,nw->n", d, d).astype(float)) * (1 + SLACK)
        doubt = doubt[~(upper[doubt] < safe[doubt])]
    if len(doubt):
        entry, lower = entry.copy(), lower.copy()
        entry[doubt], upper[doubt], lower[doubt] = scan(parts[doubt], book)
    return entry, upper, lower, len(doubt)


def _lists(a: np.ndarray, kind) -> pa.Array:
    """An array of equally long lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _round(books: np.ndarray, moved: np.ndarray | None):
    """Rows (id, label, STATE) -> the same after a round, and one row a task with what the parts that changed add: place and count or sum.

    ``books`` is (parts, entries, width). Without ``moved`` all is measured.
    """
    n_parts, n_entries, width = books.shape
    names = ["id", "label", *(f.split()[0] for f in STATE.split(", "))]

    def run(batches):
        # for each entry its number of parts, then their components' sums
        add = np.zeros((n_parts, n_entries, 1 + width), np.int64)
        half, own_kinds = np.zeros((n_parts, n_entries)), None
        if moved is not None and n_entries > 1:
            for p in range(n_parts):
                d = distances(books[p], books[p]).astype(float)
                np.fill_diagonal(d, np.inf)
                half[p] = np.sqrt(d.min(axis=1)) / 2 * (1 - SLACK)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("ints"), n_parts * width).astype(np.int64).reshape(-1, n_parts, width)
            n, own_kinds = len(v), (b.column("id").type, b.column("label").type)
            entry, upper, lower = np.zeros((n, n_parts), np.int32), np.zeros((n, n_parts)), np.zeros((n, n_parts))
            old = None
            if moved is not None:
                old = _matrix(b.column("entry"), n_parts)
                up, low = _matrix(b.column("upper"), n_parts), _matrix(b.column("lower"), n_parts)
            for p in range(n_parts):
                own = np.ascontiguousarray(v[:, p])
                if old is None:
                    entry[:, p], upper[:, p], lower[:, p] = scan(own, books[p])
                    gone, come = None, slice(None)
                else:
                    entry[:, p], upper[:, p], lower[:, p], _ = reassigned(own, old[:, p], up[:, p].copy(), low[:, p], books[p], moved[p], half[p])
                    come = gone = np.flatnonzero(entry[:, p] != old[:, p])
                x = np.concatenate([np.ones((n, 1), np.int64), own], axis=1)
                np.add.at(add[p], entry[come, p], x[come])
                if gone is not None:
                    np.subtract.at(add[p], old[gone, p], x[gone])
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("label"), b.column("ints"), _lists(entry, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64()),
                pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())),
            ], names=names)
        if own_kinds is None:
            return
        some = np.flatnonzero(add)
        kinds = [*own_kinds, *[pa.list_(k) for k in (pa.int32(), pa.int32(), pa.float64(), pa.float64())]]
        sums = [pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([add.ravel()[some]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], *sums], names=names)

    return run


def _measured(books: np.ndarray):
    """Rows (id, label, STATE) -> (id, label, code, error): two hexadecimal digits a part, exact squared distances summed."""
    n_parts, _, width = books.shape

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("ints"), n_parts * width).astype(np.int64).reshape(-1, n_parts, width)
            entry = _matrix(b.column("entry"), n_parts)
            d = v - books[np.arange(n_parts), entry]
            code = [bytes(e).hex() for e in entry.astype(np.uint8)]
            error = pa.array(np.einsum("npw,npw->n", d, d))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code), error], names=["id", "label", "code", "error"])

    return run


def _summed(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """What a round's tasks add, over all of them: a count and a vector of sums for each entry."""
    out = np.zeros(shape, np.int64)
    each = state.where("place is not null").select(F.explode(F.arrays_zip("place", "moved")).alias("a"))
    for r in each.groupBy("a.place").agg(F.sum("a.moved").alias("n")).collect():
        out.flat[r.place] = r.n
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): per kept row of ``vectors`` id, code, error, label_error; the codebooks as (parts, entries, width) integers.

    Rows whose vector is null or holds a null or non-finite component are
    dropped. A vector shorter than the longest, or than a multiple of ``parts``,
    is as if zeros followed. Integers are cut where their squared differences
    would not fit a long (+-2^27 at 64 components, |x| from 32,768). The first
    entries are the kept rows of smallest id, null ids last, rows of one id by
    their components; with fewer rows there are fewer entries. At most 256
    entries, so that an index has two digits. Rows that repeat an id give a row
    each; null labels are one label, and a sum beyond a long is null. An empty
    table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).alias("label")).where(fine(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    dim = parts * width
    rows = written(kept.select("id", "label", integers(F.col("v"), dim, scale).alias("ints")), "vectors")
    own = "id {}, label {}, ".format(*(rows.schema[c].dataType.simpleString() for c in ("id", "label")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    start = np.array([r.ints for r in first], np.int64).reshape(len(first), parts, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    state, moved = rows, None
    sums = np.zeros((parts, len(first), 1 + width), np.int64)
    for _ in range(rounds if len(first) else 0):
        new = written(state.where("place is null" if moved is not None else "true").mapInArrow(_round(books, moved), own + STATE), "codes")
        dropped(state)
        state = new
        sums += _summed(new, sums.shape)
        count = sums[:, :, :1]
        after = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)
        step = after - books
        moved = np.sqrt(np.einsum("pew,pew->pe", step, step).astype(float)) * (1 + SLACK)
        books = after
    if moved is not None:
        state = state.where("place is null")
    coded = state.mapInArrow(_round(books, moved), own + STATE).where("place is null") if first else spark.createDataFrame([], own + STATE)
    out = written(coded.mapInArrow(_measured(books), own + "code string, error long"), "codes")
    dropped(state)
    by_label = small(out.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    out = out.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("codebooks_sha256", F.lit(digest(books)))


def _oracle(dim: int = 64) -> str:
    """The same in SQL, for vectors of ``dim`` components: plain Lloyd rounds, every part measured against every entry."""
    width = dim // PARTS
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
d{k} as (select v.vec_id, v.part, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v join b{k} b using (part)),
a{k} as materialized (select vec_id, part, entry, d from d{k} qualify row_number() over (partition by vec_id, part order by d, entry) = 1)""")
        if k < ROUNDS:
            mean = ", ".join(f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, width + 1))
            steps.append(f"""
m{k} as (select part, entry, list_transform([{mean}], lambda y: y::bigint) x from v join a{k} using (vec_id, part) group by part, entry),
b{k + 1} as materialized (select part, entry, coalesce(m.x, b.x) x from b{k} b left join m{k} m using (part, entry))""")
    return f"""with kept as (select vec_id, label, embedding::double[] e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
i as (select vec_id, list_transform(e, lambda x: floor(x * {SCALE})::bigint) x from kept),
v as materialized (select vec_id, part, x[part * {width} + 1 : part * {width} + {width}] x from i, range({PARTS}) r(part)),
b0 as (select part, dense_rank() over (order by vec_id) - 1 entry, x from v where vec_id in (select vec_id from i order by vec_id limit {ENTRIES})),
{",".join(steps)},
c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from a{ROUNDS} group by vec_id),
s as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from c join kept using (vec_id), s"""


OP11_SQL = _oracle()
