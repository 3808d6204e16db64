"""Grouped reports, windows, orderings and set comparisons over fact tables (A16-A38, F, J3, J4, W, O, U)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio, share


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by an explicit ordinal. An aggregation, so frequent keys meet pre-aggregated."""
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in columns if c != order))).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in columns))


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first match of each key."""
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *(c for c in columns if c != order))).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in columns))


def last_n(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key (Spark limits groups before the shuffle)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter(F.col("__k") <= n).drop("__k")


def ordinal(df: DataFrame, keys: Sequence[str], *order: str, name: str = "ordinal") -> DataFrame:
    """Place from 0 within the keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def collapse_runs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows that repeat the one before are dropped."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    first = F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(order)).isNull()
    return df.withColumn("__new", first | ~F.col(value).eqNullSafe(before)).filter("__new").drop("__new")


def improvement(before: Column, after: Column) -> tuple[Column, Column]:
    """absolute and relative (percent; null from 0) change."""
    return after - before, F.try_divide(after - before, before) * 100


def grouped_means(df: DataFrame, dimensions: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means by each dimension by itself and over all, in one pass (grouping sets).

    (dimension, key, n, mean of each column); the whole is dimension "all" with a null key.
    """
    sets = [[F.col(d)] for d in dimensions] + [[]]
    out = df.groupingSets(sets, *dimensions).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns), F.grouping_id(*dimensions).alias("__g"))
    k = len(dimensions)
    full = (1 << k) - 1
    name, key = F.lit("all"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        only = F.col("__g") == full - (1 << (k - 1 - i))
        name, key = F.when(only, d).otherwise(name), F.when(only, F.col(d).cast("string")).otherwise(key)
    return out.select(name.alias("dimension"), key.alias("key"), "n", *columns)


def stratum(value: Column) -> Column:
    """Right-closed (0, .6], (.6, .8], (.8, 1] of a mean; outside none. An aggregate.

    The mean is held against the edges by an exact sum of the values as decimals, so a mean on an edge falls on one side in
    whatever order its rows come. Values that decimals don't hold (NaN, infinite, beyond 10^18 or below 10^-20) go by doubles.
    """
    x = value.cast("double")
    exact, n = x.try_cast("decimal(38,20)"), F.count(x).cast("decimal(15,0)")
    held = F.bool_and(x.isNull() | (exact.isNotNull() & ((exact != 0) | (x == 0))))
    total, mean = F.when(held, F.try_sum(exact)), F.avg(x)
    upto = lambda edge: F.coalesce(total <= n * F.lit(Decimal(edge)), mean <= float(edge))
    return F.when(upto("0.0"), None).when(upto("0.6"), "hard").when(upto("0.8"), "medium").when(upto("1.0"), "easy")


def strata(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Means of per-key means by difficulty of the key, and their change."""
    per = df.groupBy(key).agg(F.avg(before).alias("b"), F.avg(after).alias("a"), stratum(F.col(before)).alias("stratum"))
    out = per.filter("stratum is not null").groupBy("stratum").agg(F.count("*").alias("keys"), F.avg("b").alias("before"), F.avg("a").alias("after"))
    gain, percent = improvement(F.col("before"), F.col("after"))
    return out.withColumns({"gain": gain, "gain_percent": percent})


def strata_rows(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Each row with the stratum of its key (keys are aggregated first, then joined)."""
    per = df.groupBy(key).agg(stratum(F.col(before)).alias("stratum"))
    return df.join(per, key).filter("stratum is not null")


def rates(df: DataFrame, keys: Sequence[str], **flags: Column) -> DataFrame:
    """Rows and the share of each flag."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *(share(c).alias(n) for n, c in flags.items()))


def conditional_rate(df: DataFrame, keys: Sequence[str], success: Column, given: Column) -> DataFrame:
    """Successes among the rows where `given` holds; 0 if it never does."""
    both = F.sum((success & given).cast("long"))
    return df.groupBy(*keys).agg(F.sum(given.cast("long")).alias("given"), both.alias("successes"), ratio(both, F.sum(given.cast("long"))).alias("rate"))


def reasons(df: DataFrame, reason: Column, failed: Column) -> DataFrame:
    """Failure reasons by frequency, a missing one as Unknown error."""
    return df.filter(failed).groupBy(F.coalesce(reason, F.lit("Unknown error")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def distance_bucket(d: Column) -> Column:
    """Right-open buckets at 0, .1, .2, .3, .5, 1; beyond 999 none."""
    edges = [k / 10 for k in (0, 1, 2, 3, 5, 10, 9990)]
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = F.when((d >= lo) & (d < hi), f"[{lo:g},{hi:g})").otherwise(out)
    return out


def bucket_histogram(df: DataFrame, distance: str) -> DataFrame:
    n = df.select(distance_bucket(F.col(distance)).alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))  # six rows


def completeness(dims: Sequence[DataFrame], actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations of the dimensions' members that the facts lack.

    Dimension tables are short lists (contracts, models, temperatures); the grid is their product, kept
    by an anti-join against the distinct keys.
    """
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.withColumn("__one", F.lit(1)).join(d.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return grid.join(actual.select(*keys).distinct(), list(keys), "left_anti")


def set_report(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Members only expected ("missing") or only found ("extra"); equal sets give none."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("status", F.lit("extra")))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """nulls of each column, -1 for a column that isn't there."""
    there = [c for c in columns if c in df.columns]
    one = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in there))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(c), F.lit(0)) if c in there else F.lit(-1).cast("long")).alias("nulls")) for c in columns))).alias("x")).select("x.*")


def range_check(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """F9."""
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max")).withColumn("in_range", (F.col("min") >= lo) & (F.col("max") <= hi))


def domain_check(domain: Column, n: Column) -> Column:
    """the four known domains as predicates on n; any other is open."""
    return F.when(domain == "n >= 0", n >= 0).when(domain == "n > 0", n > 0).when(domain == "n <= 0", n <= 0).when(domain == "n < 0", n < 0).otherwise(True)


def status(value: Column) -> Column:
    """F16."""
    return F.when(value > 0.8, "WORKING").when(value > 0.3, "PARTIAL").otherwise("FAILING")


def severity(d: Column) -> Column:
    """F20."""
    return F.when(d == 0, "none").when(d < 0.3, "minor").when(d < 0.7, "moderate").otherwise("major")


def conclusion(raw: Column, structural: Column) -> Column:
    """F17, F19."""
    return F.when(structural > raw + 0.1, "SUPPORTED").when(structural > raw, "PARTIAL").otherwise("NOT")


def sweep_conclusion(df: DataFrame, keys: Sequence[str], gain: Column) -> DataFrame:
    """all gains above .05 and their mean above .1; mean above .05; else not."""
    out = df.groupBy(*keys).agg(F.bool_and(gain > 0.05).alias("all_up"), F.avg(gain).alias("mean_gain"))
    return out.withColumn("conclusion", F.when(F.col("all_up") & (F.col("mean_gain") > 0.1), "SUPPORTED").when(F.col("mean_gain") > 0.05, "PARTIALLY_SUPPORTED").otherwise("NOT_SUPPORTED"))


def progress(df: DataFrame, expected: int, minutes_each: float = 2.0) -> DataFrame:
    """Rows done, percent of those expected, minutes left."""
    return df.agg(F.count("*").alias("done")).select("done", (F.col("done") * 100.0 / expected).alias("percent"), (F.greatest(F.lit(expected) - F.col("done"), F.lit(0)) * minutes_each).alias("minutes_left"))


def todo(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't done yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")
