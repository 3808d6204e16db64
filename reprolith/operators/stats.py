"""Statistics and hypothesis tests (T1-T27) over columns and groups.

Closed forms are column expressions. Ranks come from windows over *distinct values* of a group, after
a partial count, so ties and frequent values don't travel as rows. Resampling and tests that need a
whole sample get it by `applyInPandas` per group: their groups are experiments of tens of outputs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution function, by Newton steps on erfc."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    x = 0.0
    for _ in range(80):
        error = 0.5 * math.erfc(-x / math.sqrt(2)) - p
        step = error / max(math.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-300)
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-15:
            break
    return x


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to 1e-7 and better (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of a proportion, within [0, 1]; (0, 0) without trials."""
    z = Z95 if confidence == 0.95 else normal_quantile((1 + confidence) / 2)
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(trials > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(trials > 0, F.least(F.lit(1.0), middle + half)).otherwise(0.0)


def log_factorial(x: Column) -> Column:
    """ln x! to about 1e-15 of its size: a table below 16, Stirling's series from there."""
    x = x.cast("double")
    small = F.element_at(F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16))), F.greatest(F.least(x, F.lit(15.0)), F.lit(0.0)).cast("int") + 1)
    y = F.greatest(x, F.lit(1.0))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x < 16, small).otherwise(y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + series)


def fisher(a: Column, b: Column, c: Column, d: Column, alternative: str = "two-sided") -> Column:
    """Exact p of the table [[a, b], [c, d]]; "less" sums k <= a, else all no likelier than a.

    Ties are taken with a relative tolerance of 1e-7. Sums run over the k within 40 standard deviations, and 100, of the
    mean: all others together weigh less than 1e-90, so tables of any size take about the root of their size.
    """
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    mean = (a + b) * (a + c) / F.greatest(n, F.lit(1.0))
    spread = 40 * F.sqrt(mean * (c + d) / F.greatest(n, F.lit(1.0)) * (b + d) / F.greatest(n - 1, F.lit(1.0))) + 100
    lo = F.greatest(F.lit(0.0), a - d, F.floor(mean - spread).cast("double")).cast("long")
    hi = F.least(a + b, a + c, F.ceil(mean + spread).cast("double")).cast("long")
    lf = log_factorial
    constant = lf(a + b) + lf(c + d) + lf(a + c) + lf(b + d) - lf(n)
    of = lambda k: -lf(k) - lf(a + b - k) - lf(a + c - k) - lf(d - a + k)
    once = F.array(F.struct(constant.alias("c"), of(a).alias("own"), lo.alias("lo"), hi.alias("hi"), of(lo).alias("first"), (a + b).alias("r"), (a + c).alias("s"), (d - a).alias("t"), a.alias("a")))

    def total(t: Column) -> Column:
        kept = (lambda k, at: k <= t["a"]) if alternative == "less" else (lambda k, at: at <= t["own"] + 1e-7)

        def step(state: Column, k: Column) -> Column:
            at = state["at"]
            more = F.log((t["r"] - k) * (t["s"] - k) / ((k + 1) * (t["t"] + k + 1)))
            return F.struct((at + F.when(k < t["hi"], more).otherwise(0.0)).alias("at"), (state["sum"] + F.when(kept(k, at), F.exp(t["c"] + at)).otherwise(0.0)).alias("sum"))

        return F.aggregate(F.sequence(t["lo"], t["hi"]), F.struct(t["first"].alias("at"), F.lit(0.0).alias("sum")), step, lambda state: state["sum"])

    return F.least(F.lit(1.0), F.element_at(F.transform(once, total), 1))


def odds_ratio(after_s: Column, after_f: Column, before_s: Column, before_f: Column) -> Column:
    """Null if either has no success, infinite without failures."""
    down = (after_f * before_s).cast("double")
    return F.when((after_s == 0) | (before_s == 0), None).when(down == 0, F.lit(float("inf"))).otherwise(after_s * before_f / down)


def cohen_h(p_before: Column, p_after: Column) -> Column:
    return 2 * F.asin(F.sqrt(p_after)) - 2 * F.asin(F.sqrt(p_before))


def cohen_label(h: Column) -> Column:
    """T8."""
    a = F.abs(h)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def relative_change(before: Column, after: Column) -> Column:
    """Percent; 0 if both are 0, null if only before is."""
    return F.when(before == 0, F.when(after == 0, 0.0)).otherwise((after - before) / F.nullif(before, F.lit(0.0)) * 100)


def holm(df: DataFrame, p: str, order: Sequence[str] = (), group: Sequence[str] = (), alpha: float = 0.05, monotone: bool = False) -> DataFrame:
    """Adds `holm_rank` (from 0), `adjusted_p`, `rejected`; stops at the first not rejected.

    Adjusted values after the stop are null, and not made monotone unless asked for. A family of tests is
    one group; families are what is spread over tasks.
    """
    keys = list(group)
    ordered = Window.partitionBy(*keys).orderBy(p, *order)
    out = df.withColumns({"holm_rank": F.row_number().over(ordered) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    left = F.col("__n") - F.col("holm_rank")
    fine = (F.col(p) <= alpha / left).cast("int")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("__ok", F.min(fine).over(upto))
    reached = F.coalesce(F.min(fine).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)) == 1
    adjusted = F.least(F.lit(1.0), F.col(p) * left)
    if monotone:
        out = out.withColumn("__a", adjusted)
        adjusted, reached = F.max("__a").over(upto), F.lit(True)
    return out.withColumns({"adjusted_p": F.when(reached, adjusted), "rejected": F.col("__ok") == 1}).drop("__n", "__ok", "__a")


def holm_report(df: DataFrame, p: str, order: Sequence[str] = (), alpha: float = 0.05, tests: int = 12) -> DataFrame:
    """Strictly below alpha / (tests - rank), each by itself."""
    rank = F.row_number().over(Window.orderBy(p, *order)) - 1
    return df.withColumn("holm_rank", rank).withColumn("rejected", F.col(p) < F.lit(alpha) / (tests - F.col("holm_rank")))


def describe(df: DataFrame, group: Sequence[str], value: str, sample: bool = False) -> DataFrame:
    """N, mean, median, deviation, least, greatest."""
    std = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), std.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def distribution(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Moments and quantiles; skewness and excess kurtosis are the biased ones."""
    q = [F.percentile(value, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.9, 0.95)]
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"), F.min(value).alias("min"), F.max(value).alias("max"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"), *q)


def box(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Five numbers and the whiskers' ends at 1.5 interquartile ranges."""
    out = df.groupBy(*group).agg(*(F.percentile(value, F.lit(p)).alias(n) for n, p in (("lo", 0.0), ("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("hi", 1.0))))
    r = F.col("q3") - F.col("q1")
    return out.withColumns({"whisker_lo": F.greatest("lo", F.col("q1") - 1.5 * r), "whisker_hi": F.least("hi", F.col("q3") + 1.5 * r)})


def normal_curve(df: DataFrame, group: Sequence[str], value: str, points: int = 100) -> DataFrame:
    """The fitted normal density at equal steps over each group's range; null without spread."""
    s = df.groupBy(*group).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    return s.select(*group, "i", "x", (F.exp(-z * z / 2) / (F.col("s") * math.sqrt(2 * math.pi))).alias("density"))


def _two_samples(df: DataFrame, group: Sequence[str], sample: str, value: str, first: str, second: str) -> DataFrame:
    """(group, v, a, b): counts of each distinct value in either sample."""
    rows = df.filter(F.col(sample).isin(first, second) & F.col(value).isNotNull())
    return rows.groupBy(*group, F.col(value).alias("v")).agg(F.sum((F.col(sample) == first).cast("long")).alias("a"), F.sum((F.col(sample) == second).cast("long")).alias("b"))


def mann_whitney(df: DataFrame, group: Sequence[str], sample: str, value: str, first: str, second: str) -> DataFrame:
    """U of the first sample, and the two-sided normal p with tie and continuity corrections."""
    c = _two_samples(df, group, sample, value, first, second)
    below = F.coalesce(F.sum(F.col("a") + F.col("b")).over(Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = F.col("a") + F.col("b")
    c = c.withColumn("r", below + (t + 1) / 2)
    s = c.groupBy(*group).agg(F.sum(F.col("a") * F.col("r")).alias("r1"), F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n2"), F.sum(t.cast("double") * t * t - t).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, F.col("n1") * F.col("n2") - u) - F.col("n1") * F.col("n2") / 2 - 0.5) / F.nullif(sd, F.lit(0.0))
    return s.select(*group, "n1", "n2", u.alias("u"), F.coalesce(F.least(F.lit(1.0), 2 * (1 - normal_cdf(z))), F.lit(1.0)).alias("p_u"))


def kolmogorov_smirnov(df: DataFrame, group: Sequence[str], sample: str, value: str, first: str, second: str, terms: int = 100) -> DataFrame:
    """The largest gap of the two empirical distributions, and p by Kolmogorov's series."""
    c = _two_samples(df, group, sample, value, first, second)
    upto = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    c = c.withColumns({"fa": F.sum("a").over(upto) / F.sum("a").over(whole), "fb": F.sum("b").over(upto) / F.sum("b").over(whole)})
    s = c.groupBy(*group).agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("d"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    x2 = F.col("d") * F.col("d") * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x2))
    return s.select(*group, "d", F.when(F.col("d") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))).alias("p_ks"))


def trend(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and Pearson correlation; 0 with fewer than two points or no spread."""
    return df.groupBy(*group).agg(F.coalesce(F.regr_slope(F.col(y), F.col(x)), F.lit(0.0)).alias("slope"), F.coalesce(F.corr(x, y), F.lit(0.0)).alias("r"))


def lcg(k: Column, seed: int = 12345) -> Column:
    """A well mixed number in 0..2^31-1 for each k; integers only, so any engine gives the same."""
    x = (k * 1103515245 + seed) % 2147483648
    x = ((x.bitwiseXOR(F.shiftright(x, 13))) * 69069 + 5) % 2147483648
    return x.bitwiseXOR(F.shiftright(x, 11))


#: Resamples that a task draws at a time.
RESAMPLES_EACH, _DRAWS = 250, 1 << 20


def bootstrap_means(values: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """The mean of each numbered resample: draw i of resample b is value lcg(100003 b + i) mod n."""
    n, out = len(values), []
    draws = np.arange(1, n + 1, dtype=np.int64)
    for some in np.array_split(resamples, -(-len(resamples) * n // _DRAWS)):
        x = ((some[:, None] * 100003 + draws) * 1103515245 + 12345) % 2147483648
        x = ((x ^ (x >> 13)) * 69069 + 5) % 2147483648
        out.append(values[(x ^ (x >> 11)) % n].sum(1) / n)
    return np.concatenate(out)


def bootstrap(df: DataFrame, group: Sequence[str], value: str, order: str, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by draws that depend on (resample, draw) alone.

    Values of a group become one array (an experiment's outputs); its resamples are dealt to tasks in blocks.
    """
    s = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("v"))
    s = s.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples), F.lit(RESAMPLES_EACH))))

    @F.pandas_udf("array<double>")
    def means(v: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bootstrap_means(np.asarray(x, float), np.arange(i, min(i + RESAMPLES_EACH, resamples + 1))) for x, i in zip(v, b, strict=True)])

    s = s.repartition("b").select(*group, F.explode(means("v", "b")).alias("m"))
    tail = (1 - confidence) / 2
    return s.groupBy(*group).agg(F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1 - tail)).alias("ci_high"))


def median_interval(df: DataFrame, group: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """T4: the median's interval between two order statistics, what its bootstrap tends to with more resamples.

    The ranks are n / 2 -+ z sqrt(n) / 2, down and up, within 1..n; values are found by their counts.
    """
    keys = list(group)
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    c = c.withColumns({"upto": F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy(*keys))})
    z = Z95 if confidence == 0.95 else normal_quantile((1 + confidence) / 2)
    half = F.col("n") / 2
    low = F.greatest(F.floor(half - z * F.sqrt("n") / 2), F.lit(1))
    high = F.least(F.ceil(half + z * F.sqrt("n") / 2) + 1, F.col("n"))
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank), F.col("v")))
    return c.groupBy(*keys).agg(at(low).alias("median_low"), at(high).alias("median_high"))


def _per_group(df: DataFrame, group: Sequence[str], columns: Sequence[str], schema: str, of) -> DataFrame:
    """`of(frame) -> dict` for each group's rows, of the keys and these columns alone; groups are experiments, of tens of outputs."""
    keys = list(group)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: frame[k].iloc[0] for k in keys} | of(frame)])

    rows = df.select(*dict.fromkeys([*keys, *columns]))
    return rows.groupBy(*keys).applyInPandas(run, f"{', '.join(f'{k} {df.schema[k].dataType.simpleString()}' for k in keys)}, {schema}")


def bca_interval(values: np.ndarray, counts: np.ndarray, resamples: int, confidence: float = 0.95, seed: int = 0, block: int = _DRAWS, table: int = 1 << 24) -> tuple[float, float]:
    """T3 of a sample given as distinct values in order and how often each occurs.

    Draws are made a block at a time, the same as all at once; a sample of more than `table` values isn't laid out but searched.
    """
    upto = np.cumsum(counts)
    n = int(upto[-1]) if len(upto) else 0
    if not n:
        return math.nan, math.nan
    x = np.repeat(values, counts) if n <= table else None
    take = (lambda i: values[np.searchsorted(upto, i, "right")]) if x is None else (lambda i: x[i])
    blocks = [(lo, min(lo + block, n)) for lo in range(0, n, block)]
    mean = float(sum(take(np.arange(lo, hi)).sum() for lo, hi in blocks) / n)
    if len(values) == 1:
        return mean, mean
    rng = np.random.default_rng(seed)
    means = np.array([sum(take(rng.integers(0, n, hi - lo)).sum() for lo, hi in blocks) / n for _ in range(resamples)])
    share = ((means < mean).mean() + (means <= mean).mean()) / 2
    z0 = normal_quantile(min(max(share, 1 / (2 * resamples)), 1 - 1 / (2 * resamples)))
    d = (values - mean) / (n - 1)
    a = (counts * d**3).sum() / (6 * max((counts * d**2).sum() ** 1.5, 1e-300))
    z = [z0 + normal_quantile(p) for p in ((1 - confidence) / 2, (1 + confidence) / 2)]
    low, high = (float(np.quantile(means, 0.5 * math.erfc(-(z0 + y / (1 - a * y)) / math.sqrt(2)))) for y in z)
    return low, high


def bca(df: DataFrame, group: Sequence[str], value: str, resamples: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Bias-corrected and accelerated interval of the mean (Efron, 1987).

    Only a group's distinct values and their counts go to its task. The number of tasks is given: so few bytes would be put
    in one task for all groups.
    """

    def of(frame: pd.DataFrame) -> dict:
        v = frame.dropna(subset=["__v"]).sort_values("__v")
        low, high = bca_interval(v["__v"].to_numpy(float), v["__n"].to_numpy(np.int64), resamples, confidence, seed)
        return {"bca_low": low, "bca_high": high}

    counts = df.groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    if group:
        counts = counts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    return _per_group(counts, group, ["__v", "__n"], "bca_low double, bca_high double", of)


def signed_rank(before: np.ndarray, after: np.ndarray) -> dict:
    """T14 of two samples: one-sided (after is greater); exact for up to 50 differences without ties or zeros."""
    if before.shape != after.shape:
        raise ValueError("samples differ in length")
    if len(before) < 3:
        return {"w": None, "p": None, "significant": None}
    d = after - before
    size = np.round(np.abs(d[d != 0]), 12)
    values, of, n = np.unique(size, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[of]
    w = float(ranks[d[d != 0] > 0].sum())
    p = _signed_rank_p(w, len(size), float((n**3 - n).sum()), bool((d == 0).any()))
    return {"w": w, "p": p, "significant": p < 0.05}


def _signed_rank_p(w: float, m: int, ties: float, zeros: bool) -> float:
    """One-sided p of rank sum `w` of `m` differences; `ties` is the sum of t^3 - t over equal sizes."""
    if not m:
        return 1.0
    if m <= 50 and not ties and not zeros:
        ways = np.zeros(m * (m + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, m + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return float(ways[int(w) :].sum() / 2.0**m)
    sd = math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)
    return 0.5 * math.erfc((w - m * (m + 1) / 4 - 0.5) / sd / math.sqrt(2))


def wilcoxon(df: DataFrame, group: Sequence[str], before: str, after: str) -> DataFrame:
    """T14 by group, with median and mean improvement; ranks and median come from counts of distinct differences."""
    keys = list(group)
    a, b = F.col(before).cast("double"), F.col(after).cast("double")
    pairs = df.withColumn("__d", F.when(~F.isnan(a) & ~F.isnan(b), b - a))
    c = pairs.groupBy(*keys, F.col("__d").alias("d")).agg(F.count("__d").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"upto": F.sum("n").over(upto), "whole": F.sum("n").over(Window.partitionBy(*keys))})
    middle = lambda k: F.max(F.when((F.col("n") > 0) & (F.col("upto") - F.col("n") < k) & (F.col("upto") >= k), F.col("d")))
    sums = c.groupBy(*keys).agg(
        F.max("whole").alias("n"), F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("n"))), F.lit(0)).alias("zeros"), F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("mean_gain"),
        ((middle(F.floor((F.col("whole") + 1) / 2)) + middle(F.floor(F.col("whole") / 2) + 1)) / 2).alias("median_gain"),
    )
    sizes = c.filter("d <> 0").groupBy(*keys, F.round(F.abs("d"), 12).alias("v")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("up"))
    rank = F.sum("t").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - (F.col("t") - 1) / 2
    t = F.col("t").cast("double")
    ranked = sizes.withColumn("r", rank).groupBy(*keys).agg(F.sum(F.col("up") * F.col("r")).alias("w"), F.sum("t").alias("m"), F.sum(t * t * t - t).alias("ties"))
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] or [F.lit(True)]
    out = sums.alias("x").join(ranked.alias("y"), on, "left")
    out = out.select(*(F.col(f"x.{k}").alias(k) for k in keys), "n", "zeros", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("ties", F.lit(0.0)).alias("ties"), "median_gain", "mean_gain")
    p = F.pandas_udf(lambda w, m, ties, zeros: pd.Series([_signed_rank_p(*x) for x in zip(w, m, ties, zeros > 0, strict=True)], dtype=float), "double")
    enough = F.col("n") >= 3
    out = out.withColumns({"w": F.when(enough, F.col("w")), "p": F.when(enough, p("w", "m", "ties", "zeros"))})
    return out.select(*keys, "w", "p", (F.col("p") < 0.05).alias("significant"), "median_gain", "mean_gain")


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (1995)."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        c, u = m / math.sqrt(m @ m), 1 / math.sqrt(n)
        last = c[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
        a = np.zeros(n)
        if n > 5:
            near = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * near**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -near, near
        else:
            phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        y = -math.log(max(-2.273 + 0.459 * n - y, 1e-300))
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def normality(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """T19 by group: statistic, p, is_normal."""

    def of(frame: pd.DataFrame) -> dict:
        w, p = shapiro_wilk(frame[value].dropna().to_numpy())
        return {"w": w, "p": p, "is_normal": p > 0.05}

    return _per_group(df, group, [value], "w double, p double, is_normal boolean", of)
