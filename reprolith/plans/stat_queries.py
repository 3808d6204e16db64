"""Queries of statistics and tests (T1-T27) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import stats as T
from .common import Query, read, rounded

_SPLIT = "1997-01-01"


def _table(s, d):
    """Successes (returned) and failures before and after a date, for each of 20 groups of suppliers."""
    li = read(s, d, "lineitem")
    after = F.col("l_shipdate") >= F.lit(_SPLIT).cast("timestamp_ntz")
    hit = F.col("l_returnflag") == "R"
    sums = {n: F.sum(c.cast("long")) for n, c in {"bs": ~after & hit, "bf": ~after & ~hit, "as_": after & hit, "af": after & ~hit}.items()}
    return li.groupBy((F.col("l_suppkey") % 20).alias("g")).agg(*(c.alias(n) for n, c in sums.items())).filter("bs + bf > 0 and as_ + af > 0")


_TABLE = f"""(SELECT l_suppkey % 20 AS g, sum((l_shipdate < DATE '{_SPLIT}' AND l_returnflag = 'R')::INT)::BIGINT AS bs, sum((l_shipdate < DATE '{_SPLIT}' AND l_returnflag <> 'R')::INT)::BIGINT AS bf,
  sum((l_shipdate >= DATE '{_SPLIT}' AND l_returnflag = 'R')::INT)::BIGINT AS as_, sum((l_shipdate >= DATE '{_SPLIT}' AND l_returnflag <> 'R')::INT)::BIGINT AS af
  FROM lineitem GROUP BY 1 HAVING bs + bf > 0 AND as_ + af > 0)"""
#: exp(log pmf) of k in the table's hypergeometric
_PMF = "exp(lgamma(as_+af+1) + lgamma(bs+bf+1) + lgamma(as_+bs+1) + lgamma(af+bf+1) - lgamma(as_+af+bs+bf+1) - lgamma(k+1) - lgamma(as_+af-k+1) - lgamma(as_+bs-k+1) - lgamma(bf-as_+k+1))"
_ALL_K = f"(SELECT *, {_PMF} AS p FROM (SELECT *, unnest(range(greatest(0, as_ - bf), least(as_ + af, as_ + bs) + 1)) AS k FROM {_TABLE}))"
_FISHER = f"(SELECT a.g, round(least(1.0, sum(a.p)), 9) AS p FROM {_ALL_K} a JOIN {_ALL_K} o ON a.g = o.g AND o.k = o.as_ WHERE a.p <= o.p * (1 + 1e-7) GROUP BY a.g)"


def _fisher(s, d):
    return _table(s, d).select("g", T.fisher(F.col("as_"), F.col("af"), F.col("bs"), F.col("bf")).alias("p")).withColumn("p", F.round("p", 9))


def _effects(s, d):
    t = _table(s, d).withColumns({"pb": F.col("bs") / (F.col("bs") + F.col("bf")), "pa": F.col("as_") / (F.col("as_") + F.col("af"))})
    h = T.cohen_h(F.col("pb"), F.col("pa"))
    return t.select("g", (F.col("pa") - F.col("pb")).alias("diff"), T.relative_change(F.col("pb"), F.col("pa")).alias("percent"), T.odds_ratio(F.col("as_"), F.col("af"), F.col("bs"), F.col("bf")).alias("odds"), h.alias("h"), T.cohen_label(h).alias("label"))


_EFFECTS = f"(SELECT g, pa - pb AS diff, CASE WHEN pb = 0 THEN CASE WHEN pa = 0 THEN 0 END ELSE (pa - pb) / pb * 100 END AS percent, CASE WHEN as_ = 0 OR bs = 0 THEN NULL WHEN af * bs = 0 THEN 'inf'::DOUBLE ELSE as_ * bf / (af * bs)::DOUBLE END AS odds, 2 * asin(sqrt(pa)) - 2 * asin(sqrt(pb)) AS h FROM (SELECT *, bs / (bs + bf)::DOUBLE AS pb, as_ / (as_ + af)::DOUBLE AS pa FROM {_TABLE}))"
_LABEL = "CASE WHEN abs(h) < 0.2 THEN 'negligible' WHEN abs(h) < 0.5 THEN 'small' WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END"
_HOLM = f"(SELECT g, p, row_number() OVER (ORDER BY p, g) - 1 AS k, count(*) OVER () AS n FROM {_FISHER})"
_HOLM2 = f"(SELECT *, min((p <= 0.05 / (n - k))::INT) OVER (ORDER BY k) AS ok, coalesce(min((p <= 0.05 / (n - k))::INT) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS reached FROM {_HOLM})"


def _events(s, d):
    return read(s, d, "events")


def _wilson(s, d):
    lo, hi = T.wilson(F.col("r"), F.col("n"))
    t = read(s, d, "lineitem").groupBy("l_partkey").agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("r"), F.count("*").alias("n"))
    return rounded(t.select("l_partkey", lo.alias("lo"), hi.alias("hi")))


_W = "(p + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)"
_WH = "1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)"
_PAIR = "event_type IN ('view', 'click')"
_RANKS = f"(SELECT value AS v, sum((event_type = 'view')::INT) AS a, sum((event_type = 'click')::INT) AS b FROM events WHERE {_PAIR} AND value IS NOT NULL GROUP BY 1)"
_PHI = "(CASE WHEN z >= 0 THEN 1 - u ELSE u END)"
_TAIL = "exp(-z * z / 2) / 2.5066282746310002 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"


def _bootstrap(s, d):
    docs = read(s, d, "documents").withColumn("x", F.col("n_chars").cast("double"))
    ci = T.bootstrap(docs, ["lang", "source"], "x", "doc_id")
    return ci.select("lang", "source", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("ci_low", "ci_high")))  # off exact halves


_BOOT = """
WITH v AS (SELECT lang, source, list(n_chars::DOUBLE ORDER BY doc_id) AS v FROM documents GROUP BY 1, 2),
  k AS (SELECT lang, source, v, len(v) AS n, b, unnest(range(1, len(v) + 1)) AS i FROM (SELECT *, unnest(range(1, 10001)) AS b FROM v)),
  x1 AS (SELECT *, ((b * 100003 + i) * 1103515245 + 12345) % 2147483648 AS x FROM k),
  x2 AS (SELECT * REPLACE ((xor(x, x >> 13) * 69069 + 5) % 2147483648 AS x) FROM x1),
  m AS (SELECT lang, source, b, sum(v[(xor(x, x >> 11) % n + 1)::INT]) / any_value(n) AS m FROM x2 GROUP BY 1, 2, 3)
SELECT lang, source, round(quantile_cont(m, 0.025) + 1e-7, 4) AS ci_low, round(quantile_cont(m, 0.975) + 1e-7, 4) AS ci_high FROM m GROUP BY 1, 2"""


def _months(s, d):
    m = read(s, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).agg(F.var_pop("o_totalprice").alias("var"), F.avg("o_totalprice").alias("mean"))
    return m.withColumn("one", F.lit(1))


def _trend(s, d):
    m = _months(s, d)
    return T.trend(m, ["one"], "m", "mean").select(F.round("slope", 4).alias("slope"), F.round("r", 6).alias("r"))


def _paired(s, d):
    o = read(s, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("b"), F.max("o_totalprice").alias("a"))
    return o.withColumn("g", F.col("o_custkey") % 5)


def _tests(s, d):
    e = _events(s, d).withColumn("all", F.lit(1))
    u = T.mann_whitney(e, ["all"], "event_type", "value", "view", "click").select("all", "p_u")
    return u.join(T.kolmogorov_smirnov(e, ["all"], "event_type", "value", "view", "click").select("all", "p_ks"), "all").select((F.least("p_u", "p_ks") < 0.05).alias("different"))


QUERIES: dict[str, Query] = {
    "t1_wilson": (_wilson, f"SELECT l_partkey, round(greatest(0, {_W} - {_WH}), 6) + 0.0 AS lo, round(least(1, {_W} + {_WH}), 6) + 0.0 AS hi FROM (SELECT l_partkey, sum((l_returnflag = 'R')::INT) / count(*)::DOUBLE AS p, count(*) AS n FROM lineitem GROUP BY 1)"),
    "t2_bootstrap": (_bootstrap, _BOOT),
    "t3_bca": (lambda s, d: T.bca(read(s, d, "documents").withColumn("x", F.col("n_chars").cast("double")), ["lang"], "x"), None),
    "t5_fisher": (lambda s, d: rounded(_fisher(s, d)), f"SELECT g, round(p, 6) + 0.0 AS p FROM {_FISHER}"),
    "t6_fisher_less": (lambda s, d: rounded(_table(s, d).select("g", T.fisher(F.col("as_"), F.col("af"), F.col("bs"), F.col("bf"), "less").alias("p"))), f"SELECT g, round(least(1.0, sum(p)), 6) + 0.0 AS p FROM {_ALL_K} WHERE k <= as_ GROUP BY g"),
    "t7_effect_sizes": (lambda s, d: rounded(_effects(s, d).drop("label")), f"SELECT g, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('diff', 'percent', 'odds', 'h'))} FROM {_EFFECTS}"),
    "t8_effect_labels": (lambda s, d: _effects(s, d).select("g", "label"), f"SELECT g, {_LABEL} AS label FROM {_EFFECTS}"),
    "t9_holm": (lambda s, d: rounded(T.holm(_fisher(s, d), "p", ["g"])), f"SELECT g, round(p, 6) + 0.0 AS p, k::INT AS holm_rank, round(CASE WHEN reached = 1 THEN least(1.0, p * (n - k)) END, 6) + 0.0 AS adjusted_p, ok = 1 AS rejected FROM {_HOLM2}"),
    "t10_holm_report": (lambda s, d: T.holm_report(_fisher(s, d), "p", ["g"], tests=20).select("g", "holm_rank", "rejected"), f"SELECT g, k::INT AS holm_rank, p < 0.05 / (20 - k) AS rejected FROM {_HOLM}"),
    "t11_rigorous": (lambda s, d: rounded(T.holm(_fisher(s, d), "p", ["g"]).join(_effects(s, d), "g").select("g", "adjusted_p", "rejected", "h", "label")), f"SELECT g, round(CASE WHEN reached = 1 THEN least(1.0, p * (n - k)) END, 6) + 0.0 AS adjusted_p, ok = 1 AS rejected, round(h, 6) + 0.0 AS h, {_LABEL} AS label FROM {_HOLM2} JOIN {_EFFECTS} USING (g)"),
    "t12_aggregate_fisher": (lambda s, d: rounded(_table(s, d).groupBy((F.col("g") % 4).alias("g4")).agg(*(F.sum(c).alias(c) for c in ("bs", "bf", "as_", "af"))).select("g4", T.fisher(F.col("as_"), F.col("af"), F.col("bs"), F.col("bf")).alias("p"))), "WITH t AS (SELECT g % 4 AS g, sum(bs)::BIGINT AS bs, sum(bf)::BIGINT AS bf, sum(as_)::BIGINT AS as_, sum(af)::BIGINT AS af FROM " + _TABLE + " GROUP BY 1), k AS (SELECT *, " + _PMF + " AS p FROM (SELECT *, unnest(range(greatest(0, as_ - bf), least(as_ + af, as_ + bs) + 1)) AS k FROM t)) SELECT a.g AS g4, round(least(1.0, sum(a.p)), 6) + 0.0 AS p FROM k a JOIN k o ON a.g = o.g AND o.k = o.as_ WHERE a.p <= o.p * (1 + 1e-7) GROUP BY a.g"),
    "t13_effect_tallies": (lambda s, d: _effects(s, d).agg(F.sum((F.col("h") >= 0.8).cast("long")).alias("large"), F.sum(F.col("h").between(0.5, 0.7999999).cast("long")).alias("medium"), F.sum(((F.col("h") >= 0.2) & (F.col("h") < 0.5)).cast("long")).alias("small")), f"SELECT sum((h >= 0.8)::INT)::BIGINT AS large, sum((h BETWEEN 0.5 AND 0.7999999)::INT)::BIGINT AS medium, sum((h >= 0.2 AND h < 0.5)::INT)::BIGINT AS small FROM {_EFFECTS}"),
    "t14_wilcoxon": (lambda s, d: T.wilcoxon(_paired(s, d), ["g"], "b", "a"), None),
    "t16_mann_whitney": (lambda s, d: rounded(T.mann_whitney(_events(s, d).withColumn("k", F.lit(1)), ["k"], "event_type", "value", "view", "click").drop("k"), digits=5), f"""
        WITH c AS (SELECT *, coalesce(sum(a + b) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2.0::DOUBLE AS r FROM {_RANKS}),
          s AS (SELECT sum(a * r) AS r1, sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2, sum((a + b)::DOUBLE * (a + b) * (a + b) - (a + b)) AS ties FROM c),
          q AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u0, n1 + n2 AS n FROM s),
          y AS (SELECT *, (greatest(u0, n1 * n2 - u0) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM q),
          x AS (SELECT *, {_TAIL} AS u FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM y))
        SELECT round(n1, 5) + 0.0 AS n1, round(n2, 5) + 0.0 AS n2, round(u0, 5) + 0.0 AS u, round(least(1.0, 2 * (1 - {_PHI})), 5) + 0.0 AS p_u FROM x"""),
    "t17_kolmogorov_smirnov": (lambda s, d: rounded(T.kolmogorov_smirnov(_events(s, d).withColumn("k", F.lit(1)), ["k"], "event_type", "value", "view", "click").drop("k")), f"""
        WITH c AS (SELECT abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) AS gap, a, b FROM {_RANKS}),
          s AS (SELECT max(gap) AS d, sum(a) AS n1, sum(b) AS n2 FROM c)
        SELECT round(d, 6) + 0.0 AS d, round(greatest(0, least(1, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * d * d * n1 * n2 / (n1 + n2))) FROM range(1, 101) r(k)))), 6) + 0.0 AS p_ks FROM s"""),
    "t18_significant": (_tests, None),
    "t19_shapiro": (lambda s, d: T.normality(read(s, d, "supplier").withColumn("g", F.col("s_nationkey") % 5), ["g"], "s_acctbal"), None),
    "t20_distribution": (lambda s, d: rounded(T.distribution(_events(s, d), ["event_type"], "value"), digits=4), "WITH m AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1) SELECT event_type, count(value) AS n, round(avg(value), 4) + 0.0 AS mean, round(any_value(sd), 4) + 0.0 AS std, round(var_pop(value), 4) + 0.0 AS var, round(min(value), 4) + 0.0 AS min, round(max(value), 4) + 0.0 AS max, round(avg(((value - mu) / sd) ^ 3), 4) + 0.0 AS skewness, round(avg(((value - mu) / sd) ^ 4) - 3, 4) + 0.0 AS kurtosis, " + ", ".join(f"round(quantile_cont(value, {p}), 4) + 0.0 AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95)) + " FROM events JOIN m USING (event_type) GROUP BY 1"),
    "t21_normal_curve": (lambda s, d: rounded(T.normal_curve(_events(s, d), ["event_type"], "value", 20)), "WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), x AS (SELECT *, unnest(range(0, 20)) AS i FROM m) SELECT event_type, i::INT AS i, round(lo + (hi - lo) * i / 19, 6) + 0.0 AS x, round(exp(-0.5 * pow((lo + (hi - lo) * i / 19 - m) / s, 2)) / (s * 2.5066282746310002), 6) + 0.0 AS density FROM x"),
    "t22_density_histogram": (lambda s, d: rounded(M.histogram(_events(s, d), ["event_type"], "value", 20, density=True)), "WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS t FROM events GROUP BY 1), b AS (SELECT event_type, least(floor((value - lo) / (hi - lo) * 20), 19)::INT AS bin, lo, hi, t FROM events JOIN r USING (event_type)) SELECT event_type, bin, count(*) AS n, round(lo + (hi - lo) * bin / 20, 6) + 0.0 AS bin_start, round(count(*) * 20 / (t * (hi - lo)), 6) + 0.0 AS density FROM b GROUP BY event_type, bin, lo, hi, t"),
    "t25_trend": (_trend, "WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, avg(o_totalprice) AS mean FROM orders GROUP BY 1) SELECT round(regr_slope(mean, m), 4) AS slope, round(corr(m, mean), 6) AS r FROM m"),
    "t27_box": (lambda s, d: rounded(T.box(_events(s, d), ["event_type"], "value")), "WITH q AS (SELECT event_type, min(value) AS lo, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, max(value) AS hi FROM events GROUP BY 1) SELECT event_type, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in (("lo", "lo"), ("q1", "q1"), ("q2", "q2"), ("q3", "q3"), ("hi", "hi"), ("whisker_lo", "greatest(lo, q1 - 1.5 * (q3 - q1))"), ("whisker_hi", "least(hi, q3 + 1.5 * (q3 - q1))"))) + " FROM q"),
}
