"""Repeatability metrics of groups of outputs.

Builders take the frame and the names of its columns, so they serve code and any other text. An
output is grouped by its digest, so long texts don't travel; everything else is one aggregation per
level with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tolerances of R_repair@k, and the two more of the distribution chart.
TOLERANCES = tuple(k / 20 for k in range(1, 5))
CHART_TOLERANCES = (*TOLERANCES, 1 / 4, 3 / 10)


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or `default` where b is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def share(condition: Column) -> Column:
    """Share of rows where a condition holds; null or no row counts 0."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def output_counts(df: DataFrame, group: Sequence[str], output: Column, order: str) -> DataFrame:
    """(group, digest, n, first): how often each output occurs and where first."""
    return df.groupBy(*group, F.sha2(F.coalesce(output, F.lit("")).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def repeatability(df: DataFrame, group: Sequence[str], output: Column, order: str) -> DataFrame:
    """A1-A3, O8 by group: r_raw, n_outputs, unique_outputs, modal_count, entropy, modal_first.

    Entropy is log2 N - sum(n log2 n) / N, so no second pass for the shares; the mode among equally
    frequent outputs is the one that came first, given by its first place in `order`.
    """
    n = output_counts(df, group, output, order)
    return n.groupBy(*group).agg(
        (F.max("n") / F.sum("n")).alias("r_raw"),
        F.sum("n").alias("n_outputs"),
        F.count("*").alias("unique_outputs"),
        F.max("n").alias("modal_count"),
        F.abs(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("entropy"),
        F.max_by("first", F.struct(F.col("n"), -F.col("first"))).alias("modal_first"),
    )


def output_distribution(df: DataFrame, group: Sequence[str], output: Column, order: str) -> DataFrame:
    """A2: a map from an output's first place to its count, for each group."""
    n = output_counts(df, group, output, order)
    return n.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("first", "n")))).alias("distribution"))


def signature_groups(df: DataFrame, group: Sequence[str], signature: Column, order: str) -> DataFrame:
    """Size of the largest group of equal signatures over the number of outputs."""
    return repeatability(df, group, signature, order).select(*group, F.col("r_raw").alias("r_signature"), F.col("unique_outputs").alias("n_signatures"))


def behaviour_signature(passed: Column, results: Column, order: Column) -> Column:
    """Passing outputs by their row of results, each failing one alone."""
    return F.when(passed, F.concat(F.lit("p:"), results)).otherwise(F.concat(F.lit("failed_"), order.cast("string")))


def anchors(df: DataFrame, group: Sequence[str], eligible: Column, order: str, *columns: str) -> DataFrame:
    """For each group the first eligible row in order, with the named columns."""
    return df.filter(eligible).groupBy(*group).agg(F.min(F.struct(order, *columns)).alias("a")).select(*group, F.col(f"a.{order}").alias(f"anchor_{order}"), *(F.col(f"a.{c}").alias(f"anchor_{c}") for c in columns))


def compare_to_anchor(df: DataFrame, anchor: DataFrame, group: Sequence[str], distance: Column) -> DataFrame:
    """Rows with `distance` and `is_identical`; without an anchor they are at distance 1.

    One anchor a group: Spark sends it to all executors while it is small, and joins by key beyond.
    """
    out = df.join(anchor, list(group), "left")
    return out.withColumn("distance", F.coalesce(distance, F.lit(1.0))).withColumn("is_identical", F.col("distance") == 0.0)


def anchor_metrics(df: DataFrame, group: Sequence[str], pre: str = "distance_pre", post: str = "distance_post", passed: str = "passed", partial_credit: bool = False) -> DataFrame:
    """A4-A11 by group in one aggregation over rows with distances before and after repair."""
    a, b = F.col(pre), F.col(post)
    credit = F.when((a > 0) & (b == 0), 1.0)
    if partial_credit:
        credit = credit.when((a > 0) & (b < a), 0.5)
    aggs = [
        F.count("*").alias("n"),
        F.sum((a == 0).cast("long")).alias("exact_pre"),
        F.min(a).alias("min_distance_pre"),
        share(a == 0).alias("r_anchor_pre"),
        share(b == 0).alias("r_anchor_post"),
        F.avg(a).alias("mean_distance_pre"),
        F.stddev_pop(a).alias("std_distance_pre"),
        F.avg(b).alias("mean_distance_post"),
        F.stddev_pop(b).alias("std_distance_post"),
        share(F.col(passed)).alias("canon_coverage"),
        ratio(F.sum(F.coalesce(credit, F.lit(0.0))), F.sum((a > 0).cast("long"))).alias("rescue_rate"),
    ]
    for k in TOLERANCES:
        aggs += [share(a <= k).alias(f"r_repair_at_{k}_pre"), share(b <= k).alias(f"r_repair_at_{k}_post")]
    out = df.groupBy(*group).agg(*aggs)
    out = out.withColumns({"delta_rescue": F.col("r_anchor_post") - F.col("r_anchor_pre"), "delta_mu": F.col("mean_distance_pre") - F.col("mean_distance_post")})
    return out.withColumns({f"delta_p_tau_{k}": F.col(f"`r_repair_at_{k}_post`") - F.col(f"`r_repair_at_{k}_pre`") for k in TOLERANCES})


def repair_curve(df: DataFrame, group: Sequence[str], distance: str, tolerances: Sequence[float] = CHART_TOLERANCES) -> DataFrame:
    """A7 as rows: (group, k, r_repair), inclusive of k."""
    return df.groupBy(*group).agg(*(share(F.col(distance) <= k).alias(f"k{i}") for i, k in enumerate(tolerances))).select(*group, F.explode(F.array(*(F.struct(F.lit(float(k)).alias("k"), F.col(f"k{i}").alias("r_repair")) for i, k in enumerate(tolerances)))).alias("x")).select(*group, "x.k", "x.r_repair")


def histogram(df: DataFrame, group: Sequence[str], value: str, bins: int = 10, density: bool = False) -> DataFrame:
    """Equal bins over each group's range, the last one closed; a single value lies in the middle.

    One aggregation for the range and one for the bins; the ranges, a row a group, are joined back.
    """
    spans = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("total"))
    flat = F.col("lo") == F.col("hi")
    spans = spans.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    rows = df.join(spans, list(group)) if group else df.join(F.broadcast(spans))  # one row
    bin_ = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    out = rows.filter(F.col(value).isNotNull()).withColumn("bin", bin_).groupBy(*group, "bin", "lo", "hi", "total").agg(F.count("*").alias("n"))
    edge = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins
    out = out.withColumn("bin_start", edge)
    if density:
        out = out.withColumn("density", F.col("n") * bins / (F.col("total") * (F.col("hi") - F.col("lo"))))
    return out.drop("lo", "hi", "total")


def across(df: DataFrame, columns: Sequence[str], base: str) -> DataFrame:
    """Mean, population deviation, least and greatest of each metric, mean gain over `base`, and count."""
    aggs = [F.count("*").alias("experiments")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    aggs += [F.avg(F.col(c) - F.col(base)).alias(f"{c}_gain") for c in columns if c != base]
    return df.agg(*aggs)
