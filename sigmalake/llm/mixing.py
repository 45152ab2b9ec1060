"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target number of words. A document's expected copies are its
source's target over the source's size (times its preference); the whole part
is allocated for certain, and the rest of the target is filled by documents in
the order of their random odds divided by their inclusion odds, as far as the
words fit. No window ever spans a source: ranks are found per slice of the rank
range, so a source with a third of all rows is dealt out over its slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table, words_of, written

#: Slices of a source's ranks and parts of its sums at least, and rows of the table for each slice beyond.
SLICES = 1024
SLICE_ROWS = 1 << 20
#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``: weighted shares of ``share`` x all words, none above ``most`` x its source.

    Capping and resharing by weight until none is above its cap ends where
    target = min(cap, weight x level); the level is read off prefix sums of the
    sources in the order of cap / weight. The windows run over one row per source.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.select("*", F.col("source_size").cast("double").alias("size"), weight.alias("w"))
    s = s.select("*", (F.col("size") * most).alias("cap"), (F.col("size") * most / F.col("w")).alias("full"))
    every = W.partitionBy()
    before = W.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.select(
        "*",
        (F.sum("size").over(every) * share).alias("all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.sum("w").over(onward).alias("open"),
    ).withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    # the first source, in this order, that its level does not fill sets the level of all after it
    free = F.min(F.when(F.col("level") < F.col("full"), F.struct(F.col("full"), -F.col("level")))).over(every)
    s = s.withColumn("top", -free["col2"])
    target = F.when(F.col("top").isNull() | (F.col("full") <= F.col("top")), F.col("cap")).otherwise(F.col("w") * F.col("top"))
    return s.select(*sizes.columns, target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        preference: str | None = None, seed: int = 7, weights=WEIGHTS, share: float = SHARE, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken[, row_col].

    ``copies`` is 0, 1 or 2 and ``taken`` = copies x size. Null texts have size
    0 and are never taken twice; a null source is a source of its own, last in
    order. Rows that repeat an id draw the same random number, and so do rows
    without an id whose texts are equal; among those of one size, which ones
    are taken follows their place in the table. ``preference`` names a column
    of relative inclusion weights (null: 1), which makes probabilities unequal
    within a source too; otherwise they differ between sources only. The same
    seed and rows give the same mix whatever the partitioning. An empty table
    gives an empty result. ``row_col`` names a column to carry along.
    """
    like = F.coalesce(F.col(preference).cast("double"), F.lit(1.0)) if preference else F.lit(1.0)
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.xxhash64(F.col(text_col)).cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name))
    unit = (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    source = F.col(source_col).cast("string")
    own = [F.col(row_col).alias("row")] if row_col else []
    d = docs.select(
        F.col(id_col).alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
        F.size(words_of(F.col(text_col))).cast("long").alias("size"), like.alias("like"), unit.alias("u"), F.monotonically_increasing_id().alias("uid"), *own,
    )
    d = written(d.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(SLICES)).cast("int")), "sizes")  # texts are read once; this is a few numbers a row
    slices = max(SLICES, d.count() // SLICE_ROWS)
    # partial sums per part first: a hot source meets as at most SLICES rows
    parts = d.groupBy("key", "source", "part").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("like")).alias("liked"))
    sizes = parts.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.sum("liked").alias("liked"))
    goal = targets(sizes, weights, share).select("key", "source_size", "target", "liked")
    goal = parts.select("key", "part").join(goal, "key")  # a row per source and part: the big join below has no hot key
    d = d.join(goal, ["key", "part"])
    rate = F.least(F.try_divide(F.col("target") * F.col("like"), F.col("liked")), F.lit(float(MAX_COPIES)))
    d = d.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("sure", F.floor(F.col("rate") + 1e-9))
    d = d.withColumn("p", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))
    odds = (F.col("u") / (1 - F.col("u"))) * F.try_divide(1 - F.col("p"), F.col("p"))
    d = d.withColumn("odds", F.when((F.col("p") > 1e-9) & (F.col("size") > 0), odds))
    # the source's own inclusion odds bring its odds back to an even spread over (0, 1), in the same order
    even = F.try_divide(F.col("target"), F.col("liked"))
    even = F.coalesce(even - F.floor(even + 1e-9), F.lit(0.5))
    even = F.greatest(F.least(even, F.lit(1 - 1e-6)), F.lit(1e-6))
    spread = F.col("odds") * (even / (1 - even))
    # a slice below 0 where nothing is left to draw
    drawn_slice = F.least(F.floor(spread / (1 + spread) * slices), F.lit(slices - 1))  # least() passes over nulls
    d = d.withColumn("slice", F.when(F.col("odds").isNotNull(), drawn_slice).otherwise(-1 - F.col("part")))
    # words of each slice and, in every slice, the words of the slices before it
    drawn = F.sum(F.when(F.col("slice") >= 0, F.col("size")).otherwise(0))
    per = d.groupBy("key", "target", "slice").agg(drawn.alias("drawn"), F.sum(F.col("size") * F.col("sure")).alias("certain"))
    whole = W.partitionBy("key")
    before = F.sum("drawn").over(whole.orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    per = per.select(
        "key", "slice", (F.col("target") - F.sum("certain").over(whole)).alias("rest"),
        F.coalesce(before, F.lit(0)).alias("before"), "drawn",
    )
    d = d.join(per, ["key", "slice"])
    # only the slice in which a target ends needs an order within it
    edge = (F.col("slice") >= 0) & (F.col("before") < F.col("rest")) & (F.col("before") + F.col("drawn") > F.col("rest"))
    d = d.withColumn("edge", edge).withColumn("same", F.xxhash64("id", "u"))
    clear = (F.col("slice") >= 0) & (F.col("before") + F.col("drawn") <= F.col("rest"))
    out = d.where("not edge").withColumn("extra", clear.cast("long")).unionByName(_ended(d.where("edge")))
    copies = (F.col("sure") + F.col("extra")).cast("long")
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), *([F.col("row").alias(row_col)] if row_col else []),
    )


def _ended(edge: DataFrame) -> DataFrame:
    """Rows of the slices in which a target ends, with ``extra``: 1 for those taken before it ends, in the order of their odds.

    Rows that drew the same number and have the same size are one class, so that
    an id with a third of all rows is one row in the order. The few classes in
    which a target ends are numbered by pieces of the table.
    """
    edge = written(edge, "edge")
    of = ["key", "slice", "odds", "same", "size"]
    n = edge.groupBy(*of, "before", "rest").agg(F.count("*").alias("n"))
    order = W.partitionBy("key", "slice").orderBy("odds", "same", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    # the document at the end is taken if that comes nearer to the target
    fits = F.floor((F.col("rest") - ahead) / F.col("size") + 0.5)
    n = written(n.select(*of, "n", F.greatest(F.lit(0), F.least(F.col("n"), fits)).cast("long").alias("taken")), "edge")
    d = edge.join(n, of)
    extra = F.when(F.col("taken") == F.col("n"), 1).otherwise(0).cast("long")
    clear = d.where("taken = 0 or taken = n").withColumn("extra", extra)
    some = n.where("taken > 0 and taken < n")
    if not some.limit(1).count():
        return clear.drop("n", "taken")
    # a class is numbered by its pieces: rows of a piece first, then pieces
    d = edge.join(some, of).withColumn("piece", F.shiftright("uid", 20))
    pieces = d.groupBy(*of, "piece").agg(F.count("*").alias("rows"))
    ahead = F.sum("rows").over(W.partitionBy(*of).orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.select(*of, "piece", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    place = F.row_number().over(W.partitionBy(*of, "piece").orderBy("uid"))
    d = d.withColumn("place", place).join(pieces, [*of, "piece"])
    d = d.withColumn("extra", (F.col("ahead") + F.col("place") <= F.col("taken")).cast("long"))
    return clear.unionByName(d.drop("piece", "ahead", "place")).drop("n", "taken")


def resample(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as many times as ``mix`` takes it.

    Rows are told apart by their id; where an id is null or repeats, by a number
    given to each, for which the table is written once more.
    """
    columns = docs.columns
    own = "_" * (1 + max(map(len, columns)))  # longer than any column of the table
    ids = docs.groupBy(id_col).agg(F.count("*").alias(own)).where(F.col(id_col).isNull() | (F.col(own) > 1))
    key, row = id_col, None
    if not ids.isEmpty():
        key = row = own + "row"
        docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = mix(docs, id_col, source_col, text_col, row_col=row, **how).where("copies > 0")
    copies = written(copies.select(F.col(key).alias(own + "of"), F.col("copies").cast("int").alias(own + "copies")), "copies")
    both = docs.join(small(copies), F.col(key) == F.col(own + "of"))
    return both.select(*columns, F.explode(F.sequence(F.lit(1), F.col(own + "copies"))).alias(own)).select(columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with d as (select doc_id id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint size,
             (('0x' || substr(md5(concat_ws(':', '7', doc_id::varchar)), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 u from documents),
z as (select source, sum(size)::double size from d group by source),
p as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3]::double w from z),
f as (select *, 2.0::double * size cap, 2.0::double * size / w as full from p),
l as (select *, (sum(size) over () * 1.5::double - coalesce(sum(cap) over o, 0)) / sum(w) over a level,
        from f window o as (order by "full", encode(source) nulls last rows between unbounded preceding and 1 preceding),
                      a as (order by "full", encode(source) nulls last rows between current row and unbounded following)),
t as (select l.source, l.size::bigint source_size, case when k.v is null or "full" <= k.v then cap else w * k.v end target
        from l, (select arg_min(level, struct_pack(a := "full", b := -level)) v from l where level < "full") k),
r as (select d.*, t.source_size, t.target, least(t.target / t.source_size, 2.0)::double rate from d join t on d.source is not distinct from t.source),
s as (select *, floor(coalesce(rate, 0) + 1e-9) sure from r),
q as (select *, greatest(coalesce(rate, 0) - sure, 0) p from s),
k as (select *, case when p > 1e-9 and size > 0 then (u / (1 - u)) * ((1 - p) / p) end odds from q),
c as (select *, odds / (1 + odds) rank, target - sum(size * sure) over (partition by source) rest,
             sum(case when odds is not null then size end) over (partition by source order by odds / (1 + odds) nulls last, id, size rows unbounded preceding) upto from k)
select id doc_id, size, source_size, target,
       (sure::bigint + case when rank is not null and upto - size / 2.0 <= rest then 1 else 0 end) * size taken from c
"""
