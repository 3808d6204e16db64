"""Composed analyses and the rest of the set, text and code operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compliance as C
from ..functions import text as X
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import stats as T
from ..sources import io
from .code_queries import _distinct, _each, _sql
from ..functions.distance import normalised_levenshtein
from ..functions.text import repaired
from .common import ASCII_SQL, COMPARED_SQL, FIXED_SQL, GROUP, Query, ascii_only, compared, read, rounded


def _pairwise(s, d):
    """Mean similarity of all pairs of whole outputs of an experiment, characters beyond ASCII counting as one.

    Pairs are of distinct outputs with their counts: n equal outputs are n(n-1)/2 pairs at similarity 1.
    """
    n = read(s, d, "conversations").groupBy("role", "conv_id", ascii_only("text").alias("o")).agg(F.count("*").alias("n"))
    a, b = n.alias("a"), n.alias("b")
    same = n.select("role", "conv_id", (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), (F.col("n") * (F.col("n") - 1) / 2).alias("total"))
    met = a.join(b, (F.col("a.role") == F.col("b.role")) & (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.o") < F.col("b.o")))
    pairs = (F.col("a.n") * F.col("b.n")).cast("double")
    other = met.select("a.role", "a.conv_id", pairs.alias("pairs"), (pairs * (1 - normalised_levenshtein(F.col("a.o"), F.col("b.o")))).alias("total"))
    return rounded(same.unionByName(other).groupBy("role", "conv_id").agg((F.try_divide(F.sum("total"), F.sum("pairs"))).alias("similarity")).filter("similarity is not null"))


_PAIRWISE = """
WITH o AS (SELECT role, conv_id, turn, regexp_replace(text, '[^ -~]', 'x', 'g') AS o FROM conversations)
SELECT a.role, a.conv_id, round(avg(1 - levenshtein(a.o, b.o) / greatest(length(a.o), length(b.o), 1)), 6) + 0.0 AS similarity
FROM o a JOIN o b ON a.role = b.role AND a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1, 2"""


def _ks_pairs(s, d):
    """Kolmogorov-Smirnov gaps of all pairs of event types by value, from counts of distinct values."""
    c = read(s, d, "events").filter("value is not null").groupBy("event_type", F.round("value", 0).alias("v")).agg(F.count("*").alias("n"))
    kinds = [r[0] for r in c.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of labels
    wide = c.groupBy("v").pivot("event_type", kinds).agg(F.sum("n")).na.fill(0).withColumn("g", F.lit(1))
    from pyspark.sql import Window

    upto, whole = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("g")
    shares = wide.select("g", *((F.sum(k).over(upto) / F.sum(k).over(whole)).alias(k) for k in kinds))
    pairs = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :]]
    one = shares.agg(*(F.max(F.abs(F.col(a) - F.col(b))).alias(f"{a}|{b}") for a, b in pairs))
    return rounded(one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("d")) for a, b in pairs))).alias("r")).select("r.*"))


_KS_PAIRS = """
WITH v AS (SELECT event_type, round(value, 0) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
  k AS (SELECT DISTINCT event_type FROM v), g AS (SELECT DISTINCT v FROM v),
  f AS (SELECT k.event_type, g.v, sum(coalesce(n, 0)) OVER (PARTITION BY k.event_type ORDER BY g.v) / sum(coalesce(n, 0)) OVER (PARTITION BY k.event_type) AS f FROM k CROSS JOIN g LEFT JOIN v ON v.event_type = k.event_type AND v.v = g.v)
SELECT a.event_type AS x, b.event_type AS y, round(max(abs(a.f - b.f)), 6) + 0.0 AS d FROM f a JOIN f b ON a.v = b.v AND a.event_type < b.event_type GROUP BY 1, 2"""


def _pre_post(s, d):
    """Distances before and after repair: moments, changes, and repair at six tolerances."""
    c = compared(s, d)
    aggs = [F.avg("distance_pre").alias("mean_pre"), F.avg("distance_post").alias("mean_post"), (F.avg("distance_pre") - F.avg("distance_post")).alias("delta_mu"), (F.stddev_pop("distance_pre") - F.stddev_pop("distance_post")).alias("delta_sigma")]
    aggs += [M.share(F.col("distance_post") <= k).alias(f"post_{str(k).replace('.', '_')}") for k in M.CHART_TOLERANCES]
    return rounded(c.groupBy("lang").agg(*aggs))


_PRE_POST = f"WITH {COMPARED_SQL} SELECT lang, round(avg(distance_pre), 6) + 0.0 AS mean_pre, round(avg(distance_post), 6) + 0.0 AS mean_post, round(avg(distance_pre) - avg(distance_post), 6) + 0.0 AS delta_mu, round(stddev_pop(distance_pre) - stddev_pop(distance_post), 6) + 0.0 AS delta_sigma, " + ", ".join(f"round(avg((distance_post <= {k})::INT), 6) + 0.0 AS post_{str(k).replace('.', '_')}" for k in M.CHART_TOLERANCES) + " FROM compared GROUP BY 1"


def _with_ci(s, d):
    """T4: descriptives of the lengths by language and source, with the intervals of mean and median."""
    docs = read(s, d, "documents").withColumn("x", F.col("n_chars").cast("double"))
    by = ["lang", "source"]
    out = T.describe(docs, by, "x").join(T.bootstrap(docs, by, "x", "doc_id"), by).join(T.median_interval(docs, by, "x"), by)
    return out.select(*by, "n", *(F.round(F.col(c) + 1e-7, 3).alias(c) for c in ("mean", "median", "ci_low", "ci_high", "median_low", "median_high")))


_WITH_CI = f"""
WITH v AS (SELECT lang, source, list(n_chars::DOUBLE ORDER BY doc_id) AS v, list_sort(list(n_chars::DOUBLE)) AS o, count(*) AS n FROM documents GROUP BY 1, 2),
  k AS (SELECT lang, source, v, n, b, unnest(range(1, n + 1)) AS i FROM (SELECT *, unnest(range(1, 10001)) AS b FROM v)),
  x1 AS (SELECT *, ((b * 100003 + i) * 1103515245 + 12345) % 2147483648 AS r FROM k), x2 AS (SELECT * REPLACE ((xor(r, r >> 13) * 69069 + 5) % 2147483648 AS r) FROM x1),
  m AS (SELECT lang, source, b, sum(v[(xor(r, r >> 11) % n + 1)::INT]) / any_value(n) AS m FROM x2 GROUP BY 1, 2, 3),
  c AS (SELECT lang, source, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1, 2)
SELECT lang, source, n, {', '.join(f'round({e} + 1e-7, 3) AS {c}' for c, e in {'mean': 'list_avg(v)', 'median': 'list_median(v)', 'ci_low': 'lo', 'ci_high': 'hi', 'median_low': f'o[greatest(floor(n / 2 - {T.Z95} * sqrt(n) / 2), 1)::INT]', 'median_high': f'o[least(ceil(n / 2 + {T.Z95} * sqrt(n) / 2) + 1, n)::INT]'}.items())}
FROM v JOIN c USING (lang, source)"""


def _lines(s, d):
    """Lines of a document that its repaired form changes, by place."""
    a, b = F.split("text", r"\n"), F.split(F.lower("text"), r"\n")
    return read(s, d, "documents").select("doc_id", F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda z: z)).alias("changed"))


def _flags(s, d):
    rules = ("misra_15_4", "misra_15_5", "misra_17_2", "misra_21_3")
    found = {r: C.violations_column(F.col("code"), rules=(r,)) for r in rules}
    return _each(s, d, _distinct(s, d).select("t", "k", *(F.size(v).alias(r) for r, v in found.items())))


def _identifier_changes(s, d):
    """Identifiers of a whole text that its repaired form lacks, and the other way round."""
    a = X.identifiers(ascii_only("text", " "))
    b = X.identifiers(repaired(ascii_only("text", " ")))
    both = read(s, d, "documents").select("doc_id", a.alias("a"), b.alias("b"))
    return both.select("doc_id", F.size(F.array_except("a", "b")).alias("only_text"), F.size(F.array_except("b", "a")).alias("only_repaired"))


_KEYWORDS = "('def','return','if','else','elif','for','while','in','not','and','or','is','import','from','class','range','len','print')"
_NAMES = r"list_filter(list_distinct(regexp_extract_all({}, '\b([a-z_]\w*)\b', 1)), lambda x: x NOT IN " + _KEYWORDS + ")"
_IDENTIFIER_CHANGES = f"""
WITH t AS (SELECT doc_id, {ASCII_SQL.format(' ')} AS t FROM documents), i AS (SELECT doc_id, {_NAMES.format('t')} AS a, {_NAMES.format(FIXED_SQL)} AS b FROM t)
SELECT doc_id, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_text, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INT AS only_repaired FROM i"""


QUERIES: dict[str, Query] = {
    "c2_misra_15_5_to_c5": (_flags, _sql(misra_15_4=(0, 0, 0, 0, 1), misra_15_5=(0, 0, 2, 0, 1), misra_17_2=(0, 0, 1, 0, 1), misra_21_3=(0, 0, 0, 0, 1))),
    "j10_pairwise_similarity": (_pairwise, _PAIRWISE),
    "l30_line_compare": (_lines, "SELECT doc_id, len(list_filter(list_zip(string_split(text, chr(10)), string_split(lower(text), chr(10))), lambda x: x[1] <> x[2]))::INT AS changed FROM documents"),
    "s2_string_rows": (lambda s, d: read(s, d, "orders").select(*(F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus"))).select(F.col("o_orderkey").cast("bigint").alias("k"), F.length("o_custkey").alias("digits"), "o_orderstatus"), "SELECT o_orderkey AS k, length(o_custkey::VARCHAR)::INT AS digits, o_orderstatus FROM orders"),
    "s7_provider": (lambda s, d: read(s, d, "supplier").select("s_suppkey", io.provider(F.concat(F.element_at(F.array(F.lit("gpt-"), F.lit("o1-"), F.lit("claude-"), F.lit("x-")), (F.col("s_suppkey") % 4 + 1).cast("int")), F.col("s_name"))).alias("provider")), "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 2 THEN 'anthropic' ELSE 'openai' END AS provider FROM supplier"),
    "s16_report_lines": (lambda s, d: io.report_lines(read(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), "%s: %d orders", "o_orderstatus", "n"), "SELECT o_orderstatus || ': ' || count(*) || ' orders' AS line FROM orders GROUP BY o_orderstatus"),
    "t4_describe_with_ci": (_with_ci, _WITH_CI),
    "t15_compare_metrics": (lambda s, d: rounded(M.repeatability(read(s, d, "documents"), GROUP, F.col("text"), "doc_id").join(M.anchor_metrics(compared(s, d), GROUP).select(*GROUP, "r_anchor_post"), GROUP).groupBy("lang").agg(F.avg("r_raw").alias("raw"), F.avg("r_anchor_post").alias("post"), F.avg(F.col("r_anchor_post") - F.col("r_raw")).alias("gain"))), f"WITH {COMPARED_SQL}, r AS (SELECT lang, source, max(n) / sum(n) AS r FROM (SELECT lang, source, text, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1, 2), p AS (SELECT lang, source, avg((distance_post = 0)::INT) AS p FROM compared GROUP BY 1, 2) SELECT lang, round(avg(r), 6) + 0.0 AS raw, round(avg(p), 6) + 0.0 AS post, round(avg(p - r), 6) + 0.0 AS gain FROM r JOIN p USING (lang, source) GROUP BY 1"),
    "t23_pre_post": (_pre_post, _PRE_POST),
    "t24_label_pairs": (_ks_pairs, _KS_PAIRS),
    "t26_three_tiers": (lambda s, d: rounded(M.across(M.anchor_metrics(compared(s, d), ["source"]), ["r_anchor_pre", "r_anchor_post", "canon_coverage"], "r_anchor_pre").select("experiments", "r_anchor_pre_mean", "r_anchor_post_mean", "canon_coverage_mean", "r_anchor_post_gain")), f"WITH {COMPARED_SQL}, m AS (SELECT source, avg((distance_pre = 0)::INT) AS a, avg((distance_post = 0)::INT) AS b, avg(passed::INT) AS c FROM compared GROUP BY 1) SELECT count(*) AS experiments, round(avg(a), 6) + 0.0 AS r_anchor_pre_mean, round(avg(b), 6) + 0.0 AS r_anchor_post_mean, round(avg(c), 6) + 0.0 AS canon_coverage_mean, round(avg(b - a), 6) + 0.0 AS r_anchor_post_gain FROM m"),
    "u1_set_equality": (lambda s, d: R.set_report(read(s, d, "nation").select("n_nationkey"), read(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey").agg((F.count("*") == 0).alias("equal")), "SELECT count(*) = 0 AS equal FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer UNION ALL (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation))"),
    "u4_key_union": (lambda s, d: read(s, d, "events").select("event_id", F.size(F.array_union(F.json_object_keys("props"), F.array(F.lit("k"), F.lit("z")))).alias("keys")), "SELECT event_id, len(list_distinct(list_concat(json_keys(props), ['k', 'z'])))::INT AS keys FROM events"),
    "u5_symmetric_difference": (_identifier_changes, _IDENTIFIER_CHANGES),
}
