"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and queue behind one another, over as many
epochs as the cap allows. A document's virtual finish time is its source's words up to and with it,
divided by the source's target. Documents of all sources are put in order of that time and taken
until the budget is full; at time 1 each source has delivered its target. Everything is SQL.

Both running sums are made from sums over buckets, so no window holds a source or the whole
corpus: a source's words before a hash bucket, then the order within (source, bucket); words before
a bucket of time, then the order within the one bucket in which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

#: About the rows of a bucket, in hash order and in time order; buckets at most (their sums meet in one window).
BUCKET_ROWS, MAX_BUCKETS = 250, 1 << 16
#: Slices of time that are one row in the first search for the budget's end.
SLICES = 1 << 12
MAX_EPOCHS = 3


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): weights go round by code point, null last.

    Targets share the sum of all sizes by weight; none is above cap x its source's size, and what is
    over goes to the others by weight until none is above. That is the level L at which
    sum(min(weight x L, cap x size)) is the total: sources in order of cap x size / weight are capped
    up to some rank and share the rest by weight. One row per source comes to the windows here.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("s"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    by = by.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    up = Window.orderBy(F.col("s") * cap / F.col("w"), "source")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumns({"total": F.sum("s").over(Window.partitionBy()), "capped": F.coalesce(F.sum(F.col("s") * cap).over(before), F.lit(0.0)), "open": F.sum("w").over(after)})
    # the level if all of smaller rank are capped and this one and later aren't; the first that fits
    by = by.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.min(F.when(F.col("level") * F.col("w") <= F.col("s") * cap, F.struct(F.col("s") * cap / F.col("w"), "source", "level"))).over(Window.partitionBy())
    target = F.least(F.col("w") * F.coalesce(fits["level"], F.lit(float("inf"))), F.col("s") * cap)
    return by.select("source", F.col("s").cast("long").alias("source_size"), target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = MAX_EPOCHS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken.

    `size` is the number of words, 0 for a null text; `taken` is a multiple of it, at most cap x size.
    A null source is a source. Rows of size 0 take nothing. Equal ids are ordered by size, and rows
    alike in id, source and size are interchangeable. An empty table gives an empty one. Reruns agree.
    """
    # a key without nulls, so that sources meet by plain equality
    sk = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_of(F.col(text_col).cast("string")).alias("size"))
    rows = written(rows.withColumns({"sk": sk, "h": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 32)}), "mix-sizes")
    targets = source_targets(rows, weights, cap).withColumn("sk", sk).drop("source")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).first()
    buckets = min(max(1, facts["n"] // bucket_rows), MAX_BUCKETS)

    # words of each source up to and with each document, in hash order
    rows = rows.withColumn("b", F.floor(F.col("h") * buckets / F.lit(float(1 << 32))).cast("long"))
    sums = rows.groupBy("sk", "b").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("sk").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(targets, "sk").drop("words")
    order = Window.partitionBy("sk", "b").orderBy("h", "doc_id", "size")
    queue = rows.join(sums, ["sk", "b"]).withColumns({"upto": F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(order)})
    queue = written(queue.select("doc_id", "source", "size", "source_size", "target", "sk", "b", "nth", "upto"), "mix-queue")

    # finish times of all epochs, in slices of time that hold about equally many words
    def slice_of(epoch: Column) -> Column:
        return F.floor((epoch * F.col("source_size") + F.col("upto")) / F.nullif(F.col("target"), F.lit(0.0)) * buckets)

    epochs = queue.filter("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("t", slice_of(F.col("epoch")))
    at, ahead = budget_end(written(epochs.groupBy("t").agg(F.sum("size").alias("w")), "mix-slices"), facts["budget"])

    # before the slice in which the budget ends all is taken, in it what still fits, in order of time
    finish = (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")
    run = F.sum("size").over(Window.orderBy(finish, "sk", "b", "nth", "epoch").rowsBetween(Window.unboundedPreceding, 0))
    inside = epochs.filter(F.col("t") == at).withColumn("run", run).filter(F.col("run") + ahead <= facts["budget"])
    inside = inside.groupBy("sk", "b", "nth").agg(F.count("*").alias("more"))
    whole = sum((F.when(slice_of(F.lit(e)) < at, 1).otherwise(0) for e in range(cap)), F.lit(0))
    out = queue.withColumn("whole", F.coalesce(whole, F.lit(0))).join(inside, ["sk", "b", "nth"], "left")
    taken = F.col("size") * (F.col("whole") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def budget_end(by_time: DataFrame, budget: int) -> tuple[int, int]:
    """The slice of (t, w) in which the running sum of w reaches the budget, and the sum before it; beyond all slices if none does.

    Runs of SLICES slices are searched first, then the slices of one run, so no window holds all slices.
    """

    def first(rows: DataFrame, key: str, before: int) -> tuple[int, int] | None:
        ahead = F.coalesce(F.sum("w").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + before
        row = rows.withColumn("ahead", ahead).filter(F.col("ahead") + F.col("w") >= budget).orderBy(key).first()
        return row and (row[key], row["ahead"])

    runs = by_time.groupBy(F.floor(F.col("t") / SLICES).alias("run")).agg(F.sum("w").alias("w"))
    run = first(runs, "run", 0)
    end = run and first(by_time.filter(F.floor(F.col("t") / SLICES) == run[0]), "t", run[1])
    return end or (1 << 62, 0)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them; rows that it doesn't take go."""
    plan = mix(docs, weights, cap, seed).filter("taken > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).cast("int").alias("__n"))
    keyed = docs.withColumns({"__i": F.col("doc_id").cast("long"), "__s": F.col("source").cast("string"), "__z": words_of(F.col("text").cast("string"))})
    met = F.col("__i").eqNullSafe(F.col("__id")) & F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__z") == F.col("__size"))
    plan = written(plan, "mix-plan")
    if not plan.groupBy("__id", "__source", "__size").agg(F.count("*").alias("c")).filter("c > 1").isEmpty() or not _alike(keyed).isEmpty():
        # rows alike in id, source and size are interchangeable: they are numbered on both sides
        plan = plan.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.col("__n").desc())))
        keyed = keyed.withColumn("__k", F.row_number().over(Window.partitionBy("__i", "__s", "__z").orderBy(F.xxhash64("text"))))
        met = met & (F.col("__k") == F.col("__nth"))
    return keyed.join(plan, met).withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def _alike(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("__i", "__s", "__z").agg(F.count("*").alias("c")).filter("c > 1")
