"""Queries of reports, predicates, joins, windows, orderings and set operations on the driver's tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import reports as R
from ..operators import stats as T
from .common import COMPARED_SQL, Query, compared, generations, read, rounded


def _li(s, d):
    return read(s, d, "lineitem")


def _ev(s, d):
    return read(s, d, "events")


def _facts(s, d):
    """Line items as configurations: contract = return flag, model = line status, temperature = quantity band."""
    return _li(s, d).select(F.col("l_returnflag").alias("contract_id"), F.col("l_linestatus").alias("model"), (F.floor(F.col("l_quantity") / 10) / 10).alias("temperature"), (F.col("l_discount") * 8).alias("r_raw"), (1 - F.col("l_tax") * 0.937).alias("r_structural"), "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


_FACTS = "(SELECT l_returnflag AS contract_id, l_linestatus AS model, floor(l_quantity / 10) / 10 AS temperature, l_discount * 8 AS r_raw, 1 - l_tax * 0.937 AS r_structural, l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem)"
_GRID_SQL = "WITH g AS (SELECT n_nationkey, p, day FROM nation, (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day FROM orders)), a AS (SELECT DISTINCT c_nationkey AS n_nationkey, o_orderpriority AS p, o_orderdate::DATE::VARCHAR AS day FROM orders JOIN customer ON o_custkey = c_custkey)"


def _grid(s, d):
    """Combinations of nation, priority and day on which nothing was ordered."""
    orders = read(s, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("p"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    actual = orders.join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "p", "day")
    return R.completeness([read(s, d, "nation").select("n_nationkey"), orders.select("p").distinct(), orders.select("day").distinct()], actual, ["n_nationkey", "p", "day"])


_WORDS = r"len(regexp_extract_all(text, '\S+'))"
_J4_SQL = "SELECT o_custkey, o_orderkey, o_totalprice, abs(o_totalprice - c_acctbal * 20) < 50000 AS matches FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) JOIN customer ON o_custkey = c_custkey WHERE k = 1"


def _j4(s, d):
    first = R.keep_first(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")
    return first.join(read(s, d, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "o_totalprice", (F.abs(F.col("o_totalprice") - F.col("c_acctbal") * 20) < 50000).alias("matches"))


QUERIES: dict[str, Query] = {
    "s1_typed_scan": (lambda s, d: read(s, d, "orders").select("o_orderkey", "o_totalprice").filter("o_totalprice > 400000"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000"),
    "s17_progress": (lambda s, d: rounded(R.progress(read(s, d, "orders"), 20000)), "SELECT done, round(done * 100.0 / 20000, 6) + 0.0 AS percent, round(greatest(20000 - done, 0) * 2.0, 6)::DOUBLE AS minutes_left FROM (SELECT count(*) AS done FROM orders)"),
    "s14_resume": (lambda s, d: R.todo(read(s, d, "customer").select("c_custkey"), read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "f1_equality": (lambda s, d: _li(s, d).filter(F.col("l_returnflag") == "R").groupBy("l_linestatus").agg(F.count("*").alias("n")), "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"),
    "f2_in_list": (lambda s, d: _ev(s, d).filter(F.col("event_type").isin("view", "click")).select("event_id"), "SELECT event_id FROM events WHERE event_type IN ('view', 'click')"),
    "f3_substring": (lambda s, d: read(s, d, "part").filter(F.coalesce(F.col("p_type").contains("BRASS"), F.lit(False))).select("p_partkey"), "SELECT p_partkey FROM part WHERE coalesce(contains(p_type, 'BRASS'), false)"),
    "f4_derived_flag": (lambda s, d: read(s, d, "documents").select("doc_id", ((F.col("n_chars") > 2000) | (F.col("lang") == "de")).alias("needed")), "SELECT doc_id, n_chars > 2000 OR lang = 'de' AS needed FROM documents"),
    "f5_dropna": (lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left").dropna(subset=["quality"]).select("doc_id", "quality"), "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL"),
    "f6_null_counts": (lambda s, d: R.null_counts(read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left"), ["text", "quality", "absent"]), "WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'text' AS \"column\", sum((text IS NULL)::INT)::BIGINT AS nulls FROM j UNION ALL SELECT 'quality', sum((quality IS NULL)::INT)::BIGINT FROM j UNION ALL SELECT 'absent', -1"),
    "f7_icase_substring": (lambda s, d: read(s, d, "part").filter(F.lower("p_name").contains("green")).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'green')"),
    "f8_tolerance": (lambda s, d: _li(s, d).filter((F.abs(F.col("l_discount") - 0.05) < 0.011) & (F.abs(F.col("l_tax") - 0.04) < 0.011)).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) < 0.011 AND abs(l_tax - 0.04) < 0.011"),
    "f9_range": (lambda s, d: rounded(R.range_check(_li(s, d), "l_discount", 0, 1)), "SELECT min(l_discount) AS min, max(l_discount) AS max, min(l_discount) >= 0 AND max(l_discount) <= 1 AS in_range FROM lineitem"),
    "f10_json_default": (lambda s, d: _ev(s, d).select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("absent")), "SELECT event_id, coalesce(json_extract_string(props, '$.k')::INT, -1) AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events"),
    "f11_safe_ratio": (lambda s, d: rounded(_li(s, d).select("l_orderkey", "l_linenumber", M.ratio(F.col("l_tax"), F.col("l_discount")).alias("r"), (F.col("l_tax") / F.greatest(F.col("l_discount"), F.lit(0.001))).alias("g"))), "SELECT l_orderkey, l_linenumber, round(coalesce(l_tax / nullif(l_discount, 0), 0), 6) + 0.0 AS r, round(l_tax / greatest(l_discount, 0.001), 6) + 0.0 AS g FROM lineitem"),
    "f12_domain": (lambda s, d: read(s, d, "customer").select("c_custkey", R.domain_check(F.element_at(F.array(*(F.lit(x) for x in ("n >= 0", "n > 0", "n <= 0", "n < 0", "other"))), (F.col("c_custkey") % 5 + 1).cast("int")), F.col("c_acctbal")).alias("inside")), "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_acctbal >= 0 WHEN 1 THEN c_acctbal > 0 WHEN 2 THEN c_acctbal <= 0 WHEN 3 THEN c_acctbal < 0 ELSE true END AS inside FROM customer"),
    "f13_key_presence": (lambda s, d: _ev(s, d).groupBy((F.map_contains_key(F.from_json("props", "map<string,string>"), "k") | F.map_contains_key(F.from_json("props", "map<string,string>"), "z")).alias("strict")).agg(F.count("*").alias("n")), "SELECT list_contains(json_keys(props), 'k') OR list_contains(json_keys(props), 'z') AS strict, count(*) AS n FROM events GROUP BY 1"),
    "f14_enforced": (lambda s, d: read(s, d, "orders").select("o_orderkey", (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isNotNull()).alias("required")), "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IS NOT NULL AS required FROM orders"),
    "f15_improvement": (lambda s, d: rounded(_facts(s, d).groupBy("contract_id").agg(F.avg("r_raw").alias("b"), F.avg("r_structural").alias("a")).select("contract_id", *(c.alias(n) for c, n in zip(R.improvement(F.col("b"), F.col("a")), ("gain", "percent"), strict=True)))), f"SELECT contract_id, round(a - b, 6) + 0.0 AS gain, round((a - b) / b * 100, 6) + 0.0 AS percent FROM (SELECT contract_id, avg(r_raw) AS b, avg(r_structural) AS a FROM {_FACTS} GROUP BY 1)"),
    "f16_status": (lambda s, d: compared(s, d).select("doc_id", R.status(1 - F.col("distance_pre")).alias("status")), f"WITH {COMPARED_SQL} SELECT doc_id, CASE WHEN 1 - distance_pre > 0.8 THEN 'WORKING' WHEN 1 - distance_pre > 0.3 THEN 'PARTIAL' ELSE 'FAILING' END AS status FROM compared"),
    "f17_hypothesis": (lambda s, d: _facts(s, d).groupBy("contract_id", "model").agg(R.conclusion(F.avg("r_raw"), F.avg("r_structural")).alias("conclusion")), f"SELECT contract_id, model, CASE WHEN avg(r_structural) > avg(r_raw) + 0.1 THEN 'SUPPORTED' WHEN avg(r_structural) > avg(r_raw) THEN 'PARTIAL' ELSE 'NOT' END AS conclusion FROM {_FACTS} GROUP BY 1, 2"),
    "f18_sweep": (lambda s, d: rounded(R.sweep_conclusion(_facts(s, d).groupBy("contract_id", "temperature").agg(F.avg("r_raw").alias("b"), F.avg("r_structural").alias("a")), ["contract_id"], F.col("a") - F.col("b"))), f"SELECT contract_id, all_up, round(g, 6) + 0.0 AS mean_gain, CASE WHEN all_up AND g > 0.1 THEN 'SUPPORTED' WHEN g > 0.05 THEN 'PARTIALLY_SUPPORTED' ELSE 'NOT_SUPPORTED' END AS conclusion FROM (SELECT contract_id, bool_and(g > 0.05) AS all_up, avg(g) AS g FROM (SELECT contract_id, temperature, avg(r_structural) - avg(r_raw) AS g FROM {_FACTS} GROUP BY 1, 2) GROUP BY 1)"),
    "f20_severity": (lambda s, d: compared(s, d).groupBy(R.severity(F.col("distance_post")).alias("severity")).agg(F.count("*").alias("n")), f"WITH {COMPARED_SQL} SELECT CASE WHEN distance_post = 0 THEN 'none' WHEN distance_post < 0.3 THEN 'minor' WHEN distance_post < 0.7 THEN 'moderate' ELSE 'major' END AS severity, count(*) AS n FROM compared GROUP BY 1"),
    "j3_missing_grid": (_grid, f"{_GRID_SQL} SELECT * FROM g ANTI JOIN a USING (n_nationkey, p, day)"),
    "j4_first_match": (_j4, _J4_SQL),
    "j5_label_pairs": (lambda s, d: (lambda e: e.alias("a").join(e.alias("b"), F.col("a.event_type") < F.col("b.event_type")).select(F.col("a.event_type").alias("x"), F.col("b.event_type").alias("y"), (F.round(F.col("a.m") - F.col("b.m"), 6) + 0.0).alias("gap")))(_ev(s, d).groupBy("event_type").agg(F.avg("value").alias("m"))), "WITH e AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT a.event_type AS x, b.event_type AS y, round(a.m - b.m, 6) + 0.0 AS gap FROM e a JOIN e b ON a.event_type < b.event_type"),
    "j7_before_after": (lambda s, d: rounded(_facts(s, d).groupBy("contract_id").agg(F.avg("r_raw").alias("before"), F.avg("r_structural").alias("after"))), f"SELECT contract_id, round(avg(r_raw), 6) + 0.0 AS before, round(avg(r_structural), 6) + 0.0 AS after FROM {_FACTS} GROUP BY 1"),
    "j8_set_difference": (lambda s, d: read(s, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct().join(_ev(s, d).select("user_id").distinct(), "user_id", "left_anti"), "SELECT o_custkey AS user_id FROM orders EXCEPT SELECT user_id FROM events"),
    "a16_describe": (lambda s, d: rounded(T.describe(_ev(s, d), ["event_type"], "value")), "SELECT event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, round(stddev_pop(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max FROM events GROUP BY 1"),
    "a17_overall": (lambda s, d: rounded(_facts(s, d).agg(F.avg("r_raw").alias("mean"), F.stddev_samp("r_raw").alias("std"), F.min("r_raw").alias("min"), F.max("r_raw").alias("max"))), f"SELECT round(avg(r_raw), 6) + 0.0 AS mean, round(stddev_samp(r_raw), 6) + 0.0 AS std, round(min(r_raw), 6) + 0.0 AS min, round(max(r_raw), 6) + 0.0 AS max FROM {_FACTS}"),
    "a18_by_dimension": (lambda s, d: rounded(R.grouped_means(_facts(s, d), ["contract_id", "model"], ["r_raw", "r_structural"])), f"SELECT CASE grouping_id(contract_id, model) WHEN 1 THEN 'contract_id' WHEN 2 THEN 'model' ELSE 'all' END AS dimension, coalesce(contract_id, model) AS key, count(*) AS n, round(avg(r_raw), 6) + 0.0 AS r_raw, round(avg(r_structural), 6) + 0.0 AS r_structural FROM {_FACTS} GROUP BY GROUPING SETS ((contract_id), (model), ())"),
    "a19_group_size": (lambda s, d: _facts(s, d).groupBy("contract_id", "model", "temperature").agg(F.count("*").alias("n")), f"SELECT contract_id, model, temperature, count(*) AS n FROM {_FACTS} GROUP BY ALL"),
    "a20_distinct": (lambda s, d: _ev(s, d).groupBy("event_type").agg(F.count_distinct("user_id").alias("users")), "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "a21_effectiveness": (lambda s, d: rounded(R.grouped_means(_facts(s, d).withColumn("needed", (F.col("r_structural") > F.col("r_raw") + 0.6).cast("double")), ["contract_id", "model"], ["needed", "r_raw"])), f"SELECT CASE grouping_id(contract_id, model) WHEN 1 THEN 'contract_id' WHEN 2 THEN 'model' ELSE 'all' END AS dimension, coalesce(contract_id, model) AS key, count(*) AS n, round(avg((r_structural > r_raw + 0.6)::INT), 6) + 0.0 AS needed, round(avg(r_raw), 6) + 0.0 AS r_raw FROM {_FACTS} GROUP BY GROUPING SETS ((contract_id), (model), ())"),
    "a22_strata": (lambda s, d: rounded(R.strata(_li(s, d).select("l_suppkey", (F.col("l_discount") * 12).alias("b"), (1 - F.col("l_tax")).alias("a")), "l_suppkey", "b", "a")), "WITH k AS (SELECT l_suppkey, avg(l_discount * 12) AS b, avg(1 - l_tax) AS a FROM lineitem GROUP BY 1), t AS (SELECT *, CASE WHEN b <= 0 THEN NULL WHEN b <= 0.6 THEN 'hard' WHEN b <= 0.8 THEN 'medium' WHEN b <= 1 THEN 'easy' END AS stratum FROM k) SELECT stratum, count(*) AS keys, round(avg(b), 6) + 0.0 AS before, round(avg(a), 6) + 0.0 AS after, round(avg(a) - avg(b), 6) + 0.0 AS gain, round((avg(a) - avg(b)) / avg(b) * 100, 6) + 0.0 AS gain_percent FROM t WHERE stratum IS NOT NULL GROUP BY 1"),
    "a23_stratum_rows": (lambda s, d: rounded(R.strata_rows(_li(s, d).select("l_suppkey", (F.col("l_discount") * 12).alias("b"), (1 - F.col("l_tax")).alias("a")), "l_suppkey", "b", "a").groupBy("stratum").agg(F.count("*").alias("configs"), (F.count("*") * 20).alias("generations"), F.avg("a").alias("mean_after"))), "WITH k AS (SELECT l_suppkey, avg(l_discount * 12) AS b FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey, CASE WHEN b <= 0 THEN NULL WHEN b <= 0.6 THEN 'hard' WHEN b <= 0.8 THEN 'medium' WHEN b <= 1 THEN 'easy' END AS stratum FROM k) SELECT stratum, count(*) AS configs, count(*) * 20 AS generations, round(avg(1 - l_tax), 6) + 0.0 AS mean_after FROM lineitem JOIN t USING (l_suppkey) WHERE stratum IS NOT NULL GROUP BY 1"),
    "a24_rates": (lambda s, d: rounded(R.rates(generations(s, d), ["lang"], oracle_pass_rate=F.col("passed"), contract_adherence_rate=F.col("adherent"))), f"WITH {COMPARED_SQL} SELECT lang, count(*) AS total, round(avg(passed::INT), 6) + 0.0 AS oracle_pass_rate, round(avg(adherent::INT), 6) + 0.0 AS contract_adherence_rate FROM gens GROUP BY 1"),
    "a25_conditional": (lambda s, d: rounded(R.conditional_rate(generations(s, d), ["source"], F.col("passed"), F.col("adherent"))), f"WITH {COMPARED_SQL} SELECT source, sum(adherent::INT)::BIGINT AS given, sum((passed AND adherent)::INT)::BIGINT AS successes, round(coalesce(sum((passed AND adherent)::INT) / nullif(sum(adherent::INT), 0), 0), 6) + 0.0 AS rate FROM gens GROUP BY 1"),
    "a26_tallies": (lambda s, d: rounded(compared(s, d).groupBy("lang").agg(F.count("*").alias("attempts"), F.sum((F.col("distance_pre") > 0).cast("long")).alias("needed"), F.sum(((F.col("distance_pre") > 0) & (F.col("distance_post") < F.col("distance_pre"))).cast("long")).alias("success")).withColumn("percent", M.ratio(F.col("success") * 100.0, F.col("needed")))), f"WITH {COMPARED_SQL} SELECT lang, count(*) AS attempts, sum((distance_pre > 0)::INT)::BIGINT AS needed, sum((distance_pre > 0 AND distance_post < distance_pre)::INT)::BIGINT AS success, round(coalesce(sum((distance_pre > 0 AND distance_post < distance_pre)::INT) * 100.0 / nullif(sum((distance_pre > 0)::INT), 0), 0), 6) + 0.0 AS percent FROM compared GROUP BY 1"),
    "a27_reasons": (lambda s, d: R.reasons(_ev(s, d), F.when(F.get_json_object("props", "$.k").cast("int") > 50, F.concat(F.lit("k"), F.get_json_object("props", "$.k"))), F.col("event_type") == "error"), "SELECT coalesce(CASE WHEN json_extract_string(props, '$.k')::INT > 50 THEN 'k' || json_extract_string(props, '$.k') END, 'Unknown error') AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1"),
    "a28_frequency": (lambda s, d: read(s, d, "conversations").select(F.explode(F.filter(F.split("text", r"\n"), lambda x: x != "")).alias("line")).groupBy(F.substring("line", 1, 4).alias("head")).agg(F.count("*").alias("n")), "SELECT substr(line, 1, 4) AS head, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE line <> '' GROUP BY 1"),
    "a29_distance_buckets": (lambda s, d: rounded(R.bucket_histogram(compared(s, d), "distance_pre")), f"WITH {COMPARED_SQL}, b AS (SELECT CASE WHEN distance_pre < 0.1 THEN '[0,0.1)' WHEN distance_pre < 0.2 THEN '[0.1,0.2)' WHEN distance_pre < 0.3 THEN '[0.2,0.3)' WHEN distance_pre < 0.5 THEN '[0.3,0.5)' WHEN distance_pre < 1 THEN '[0.5,1)' ELSE '[1,999)' END AS bucket FROM compared) SELECT bucket, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE + 0.0 AS percent FROM b GROUP BY 1"),
    "a30_by_outcome": (lambda s, d: rounded(compared(s, d).groupBy("passed").agg(F.min("distance_pre").alias("min"), F.max("distance_pre").alias("max"), F.avg("distance_pre").alias("mean"))), f"WITH {COMPARED_SQL} SELECT passed, round(min(distance_pre), 6) + 0.0 AS min, round(max(distance_pre), 6) + 0.0 AS max, round(avg(distance_pre), 6) + 0.0 AS mean FROM compared GROUP BY 1"),
    "a31_level_counts": (lambda s, d: compared(s, d).groupBy(F.when(F.col("distance_pre") < 0.1, 0).when(F.col("distance_post") < 0.1, 2).otherwise(3).alias("level")).agg(F.count("*").alias("n")), f"WITH {COMPARED_SQL} SELECT CASE WHEN distance_pre < 0.1 THEN 0 WHEN distance_post < 0.1 THEN 2 ELSE 3 END AS level, count(*) AS n FROM compared GROUP BY 1"),
    "a32_per_temperature": (lambda s, d: rounded(_facts(s, d).groupBy("contract_id", "temperature").agg(F.avg((F.col("r_raw") > 0.4).cast("double")).alias("needed")).groupBy("contract_id").agg(F.count("*").alias("temperatures"), F.avg("needed").alias("mean_needed"))), f"SELECT contract_id, count(*) AS temperatures, round(avg(needed), 6) + 0.0 AS mean_needed FROM (SELECT contract_id, temperature, avg((r_raw > 0.4)::INT) AS needed FROM {_FACTS} GROUP BY 1, 2) GROUP BY 1"),
    "a33_compliance_tallies": (lambda s, d: generations(s, d).groupBy("source").agg(F.count("*").alias("total"), F.sum(F.col("passed").cast("long")).alias("oracle_pass"), F.sum(F.col("adherent").cast("long")).alias("compliant"), F.sum((F.col("passed") & F.col("adherent")).cast("long")).alias("both")), f"WITH {COMPARED_SQL} SELECT source, count(*) AS total, sum(passed::INT)::BIGINT AS oracle_pass, sum(adherent::INT)::BIGINT AS compliant, sum((passed AND adherent)::INT)::BIGINT AS both FROM gens GROUP BY 1"),
    "a34_exact_match": (lambda s, d: rounded(compared(s, d).groupBy("lang").agg(F.avg((F.col("distance_pre") == 0).cast("double")).alias("exact_rate"))), f"WITH {COMPARED_SQL} SELECT lang, round(avg((distance_pre = 0)::INT), 6) + 0.0 AS exact_rate FROM compared GROUP BY 1"),
    "a37_severity_totals": (lambda s, d: rounded(compared(s, d).filter("distance_pre >= 0.1").groupBy("source").agg(F.sum("distance_pre").alias("total"), F.count("*").alias("n"))), f"WITH {COMPARED_SQL} SELECT source, round(sum(distance_pre), 6) + 0.0 AS total, count(*) AS n FROM compared WHERE distance_pre >= 0.1 GROUP BY 1"),
    "w1_keep_last": (lambda s, d: R.keep_last(_li(s, d).select("l_partkey", "l_orderkey", "l_linenumber").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["l_partkey"], "ord"), "SELECT l_partkey, l_orderkey, l_linenumber, ord FROM (SELECT *, l_orderkey * 10 + l_linenumber AS ord, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) AS k FROM lineitem) WHERE k = 1"),
    "w5_last_n": (lambda s, d: R.last_n(read(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 5), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 5"),
    "w6_average_rank": (lambda s, d: R.average_rank(_li(s, d).select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_suppkey"], "l_quantity"), "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem"),
    "w9_ordinal": (lambda s, d: R.ordinal(read(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey"), "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ordinal FROM orders"),
    "w10_collapse": (lambda s, d: R.collapse_runs(_ev(s, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type"),
    "o1_sorted_keys": (lambda s, d: read(s, d, "part").select("p_brand").distinct().orderBy("p_brand"), "SELECT DISTINCT p_brand FROM part ORDER BY 1"),
    "o3_sort_desc": (lambda s, d: read(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type"), "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1"),
    "o5_top_n": (lambda s, d: read(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "o6_arg_max": (lambda s, d: _li(s, d).groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct(F.col("l_quantity") * F.col("l_discount"), -F.col("l_linenumber"))).alias("best")), "SELECT l_orderkey, l_linenumber AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_discount DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1"),
    "o7_last_files": (lambda s, d: read(s, d, "pages").select("url").orderBy(F.desc("url")).limit(15), "SELECT url FROM pages ORDER BY url DESC LIMIT 15"),
    "u2_set_report": (lambda s, d: R.set_report(read(s, d, "customer").select("c_custkey"), read(s, d, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 50).alias("c_custkey")), "c_custkey"), "WITH e AS (SELECT DISTINCT c_custkey FROM customer), a AS (SELECT DISTINCT o_custkey + o_orderkey % 50 AS c_custkey FROM orders) SELECT c_custkey, 'missing' AS status FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT c_custkey, 'extra' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)"),
    "u3_intersection": (lambda s, d: read(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("q")).select("o_custkey", F.size(F.array_intersect("p", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))).alias("common"), F.size(F.array_union("p", "q")).alias("all")), "SELECT o_custkey, (count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')))::INT AS common, (count(DISTINCT o_orderpriority) + count(DISTINCT o_orderstatus))::INT AS \"all\" FROM orders GROUP BY 1"),
    "u6_concat_runs": (lambda s, d: _ev(s, d).filter("event_type = 'view'").select("event_id", "value").unionByName(_ev(s, d).filter("event_type = 'error'").select("event_id", "value")), "SELECT event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, value FROM events WHERE event_type = 'error'"),
    "u7_extra_lines": (lambda s, d: read(s, d, "conversations").select("conv_id", "turn", F.size(F.filter(F.transform(F.split("text", r"\n"), F.trim), lambda x: (x != "") & ~x.startswith("T"))).alias("extra")), "SELECT conv_id, turn, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, 'T')))::INT AS extra FROM conversations"),
}
