"""Queries of the repeatability metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from .common import COMPARED_SQL, GROUP, Query, compared, generations, read, rounded, sql_round

_KEYS = "lang, source"
_COUNTS = "SELECT lang, source, text, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL"


def _repeat(spark, sf):
    return M.repeatability(read(spark, sf, "documents"), GROUP, F.col("text"), "doc_id")


def _all(spark, sf):
    return M.anchor_metrics(compared(spark, sf), GROUP)


_METRICS_SQL = f"""WITH {COMPARED_SQL}
SELECT lang, source, count(*) AS n, sum((distance_pre = 0)::BIGINT)::BIGINT AS exact_pre, min(distance_pre) AS min_distance_pre,
  avg((distance_pre = 0)::INT) AS r_anchor_pre, avg((distance_post = 0)::INT) AS r_anchor_post,
  avg(distance_pre) AS mean_distance_pre, stddev_pop(distance_pre) AS std_distance_pre, avg(distance_post) AS mean_distance_post, stddev_pop(distance_post) AS std_distance_post,
  avg(passed::INT) AS canon_coverage,
  coalesce(sum(CASE WHEN distance_pre > 0 AND distance_post = 0 THEN 1.0 ELSE 0 END) / nullif(sum((distance_pre > 0)::INT), 0), 0) AS rescue_rate,
  {', '.join(f'avg((distance_{s} <= {k})::INT) AS "r_repair_at_{k}_{s}"' for k in M.TOLERANCES for s in ('pre', 'post'))}
FROM compared GROUP BY lang, source"""


def _part(*columns: str):
    """A projection of the one aggregation that gives all anchor metrics."""
    return lambda spark, sf: rounded(_all(spark, sf).select(*GROUP, *(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in columns)))


def _part_sql(**columns: str) -> str:
    return f"SELECT lang, source, {', '.join(f'round({e}, 6) + 0.0 AS {c}' for c, e in columns.items())} FROM ({_METRICS_SQL})"


def _summary(spark, sf):
    """The 35-column fact row of each experiment, values to three decimals."""
    rows = _all(spark, sf).join(_repeat(spark, sf).select(*GROUP, "r_raw"), GROUP)
    r3 = lambda c: (F.round(F.col(f"`{c}`"), 3) + 0.0)
    names = {"Delta_rescue": "delta_rescue", "R_anchor_pre": "r_anchor_pre", "R_anchor_post": "r_anchor_post", "R_raw": "r_raw", "Delta_mu": "delta_mu", "canon_coverage": "canon_coverage", "rescue_rate": "rescue_rate"}
    names |= {c: c for c in ("mean_distance_pre", "std_distance_pre", "mean_distance_post", "std_distance_post")}
    return rows.select(F.concat_ws("_", "lang", "source").alias("experiment_id"), F.lit("unknown").alias("repo_commit"), F.col("lang").alias("contract_id"), F.col("source").alias("model"), F.col("n").alias("runs"), *(r3(c).alias(n) for n, c in names.items()), *(r3(f"r_repair_at_{k}_{s}").alias(f"R_repair_at_{k}_{s}".replace(".", "_")) for k in M.TOLERANCES for s in ("pre", "post")), *(r3(f"delta_p_tau_{k}").alias(f"Delta_P_tau_{k}".replace(".", "_")) for k in M.TOLERANCES))


def _behaviour(spark, sf):
    """Passing documents by a coarse row of results, failing ones alone."""
    results = F.concat_ws("", *((F.size(F.split(F.col("text"), r"\n")) > k).cast("int").cast("string") for k in (1, 3, 9)), (F.col("n_chars") > 1000).cast("int").cast("string"))
    out = M.signature_groups(generations(spark, sf), GROUP, M.behaviour_signature(F.col("passed"), results, F.col("doc_id")), "doc_id")
    return rounded(out.withColumnRenamed("r_signature", "r_behavioral"))


def _structure(spark, sf):
    """By a stable hash of four properties of the repaired text."""
    docs = read(spark, sf, "documents").withColumn("lines", F.size(F.split("text", "\n")))
    props = F.to_json(F.struct("lines", F.floor(F.log2(F.col("n_chars").cast("double"))).alias("size"), F.substring("text", 1, 1).alias("head"), "lang"))
    return rounded(M.signature_groups(docs, ["source"], props, "doc_id").select("source", F.col("r_signature").alias("r_structural"), "n_signatures"))


_ENTROPY = "abs(log2(sum(n)) - sum(n * log2(n)) / sum(n))"

QUERIES: dict[str, Query] = {
    "a1_r_raw": (lambda s, d: rounded(_repeat(s, d).select(*GROUP, "r_raw", "n_outputs")), f"SELECT lang, source, round(max(n) / sum(n), 6) + 0.0 AS r_raw, sum(n)::BIGINT AS n_outputs FROM ({_COUNTS}) GROUP BY lang, source"),
    "a2_unique_outputs": (lambda s, d: _repeat(s, d).select(*GROUP, "unique_outputs", "modal_count"), f"SELECT lang, source, count(*) AS unique_outputs, max(n) AS modal_count FROM ({_COUNTS}) GROUP BY lang, source"),
    "a2_distribution": (lambda s, d: M.output_distribution(read(s, d, "documents"), GROUP, F.col("text"), "doc_id").select(*GROUP, F.explode("distribution").alias("first", "n")), f"SELECT lang, source, first, n FROM ({_COUNTS})"),
    "a3_entropy": (lambda s, d: rounded(_repeat(s, d).select(*GROUP, "entropy")), f"SELECT lang, source, round({_ENTROPY}, 6) + 0.0 AS entropy FROM ({_COUNTS}) GROUP BY lang, source"),
    "o8_mode": (lambda s, d: _repeat(s, d).select(*GROUP, "modal_first"), f"SELECT lang, source, first AS modal_first FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n DESC, first) AS k FROM ({_COUNTS})) WHERE k = 1"),
    "w2_canon_selection": (lambda s, d: compared(s, d).groupBy(*GROUP).agg(F.coalesce(F.max("anchor_id"), F.lit(-1)).alias("anchor_id")), f"WITH {COMPARED_SQL} SELECT lang, source, coalesce(max(anchor_id), -1) AS anchor_id FROM compared GROUP BY lang, source"),
    "w3_canon_strict": (lambda s, d: M.anchors(generations(s, d).select("doc_id", *GROUP, "passed", "adherent"), GROUP, F.col("passed") & F.col("adherent"), "doc_id").select(*GROUP, "anchor_doc_id"), f"WITH {COMPARED_SQL} SELECT lang, source, min(doc_id) AS anchor_doc_id FROM gens WHERE passed AND adherent GROUP BY lang, source"),
    "j1_compare_to_canon": (lambda s, d: rounded(compared(s, d).select("doc_id", "distance_pre", (F.col("distance_pre") == 0).alias("is_identical"))), f"WITH {COMPARED_SQL} SELECT doc_id, round(distance_pre, 6) + 0.0 AS distance_pre, distance_pre = 0 AS is_identical FROM compared"),
    "j2_raw_repaired": (lambda s, d: rounded(compared(s, d).select("doc_id", "distance_pre", "distance_post", (F.col("distance_post") < F.col("distance_pre")).alias("nearer"))), f"WITH {COMPARED_SQL} SELECT doc_id, round(distance_pre, 6) + 0.0 AS distance_pre, round(distance_post, 6) + 0.0 AS distance_post, distance_post < distance_pre AS nearer FROM compared"),
    "a4_r_anchor": (_part("r_anchor_pre", "r_anchor_post"), _part_sql(r_anchor_pre="r_anchor_pre", r_anchor_post="r_anchor_post")),
    "a5_anchor_stats": (lambda s, d: rounded(_all(s, d).select(*GROUP, "exact_pre", "n", "mean_distance_pre", "min_distance_pre")), f"SELECT lang, source, exact_pre, n, round(mean_distance_pre, 6) + 0.0 AS mean_distance_pre, round(min_distance_pre, 6) + 0.0 AS min_distance_pre FROM ({_METRICS_SQL})"),
    "a6_delta_rescue": (_part("delta_rescue"), _part_sql(delta_rescue="r_anchor_post - r_anchor_pre")),
    "a7_r_repair": (_part(*(f"r_repair_at_{k}_{s}" for k in M.TOLERANCES for s in ("pre", "post"))), _part_sql(**{f"r_repair_at_{k}_{s}".replace(".", "_"): f'"r_repair_at_{k}_{s}"' for k in M.TOLERANCES for s in ("pre", "post")})),
    "a7_repair_curve": (lambda s, d: rounded(M.repair_curve(compared(s, d), GROUP, "distance_post")), f"WITH {COMPARED_SQL} SELECT lang, source, k::DOUBLE AS k, round(avg((distance_post <= k)::INT), 6) + 0.0 AS r_repair FROM compared, (SELECT unnest([5, 10, 15, 20, 25, 30]) / 100 AS k) GROUP BY lang, source, k"),
    "a8_delta_p_tau": (_part(*(f"delta_p_tau_{k}" for k in M.TOLERANCES)), _part_sql(**{f"delta_p_tau_{k}".replace(".", "_"): f'"r_repair_at_{k}_post" - "r_repair_at_{k}_pre"' for k in M.TOLERANCES})),
    "a9_delta_mu": (_part("mean_distance_pre", "std_distance_pre", "mean_distance_post", "std_distance_post", "delta_mu"), _part_sql(**{c: c for c in ("mean_distance_pre", "std_distance_pre", "mean_distance_post", "std_distance_post")}, delta_mu="mean_distance_pre - mean_distance_post")),
    "a10_canon_coverage": (_part("canon_coverage"), _part_sql(canon_coverage="canon_coverage")),
    "a11_rescue_rate": (_part("rescue_rate"), _part_sql(rescue_rate="rescue_rate")),
    "a11_rescue_partial": (lambda s, d: rounded(M.anchor_metrics(compared(s, d), GROUP, partial_credit=True).select(*GROUP, "rescue_rate")), f"WITH {COMPARED_SQL} SELECT lang, source, round(coalesce(sum(CASE WHEN distance_pre > 0 AND distance_post = 0 THEN 1.0 WHEN distance_pre > 0 AND distance_post < distance_pre THEN 0.5 ELSE 0 END) / nullif(sum((distance_pre > 0)::INT), 0), 0), 6) + 0.0 AS rescue_rate FROM compared GROUP BY lang, source"),
    "a12_r_behavioral": (_behaviour, r"""
        WITH g AS (SELECT d.doc_id, lang, source, CASE WHEN coalesce(l.quality = 1, false) THEN
            concat('p:', (len(string_split(text, chr(10))) > 1)::INT, (len(string_split(text, chr(10))) > 3)::INT, (len(string_split(text, chr(10))) > 9)::INT, (n_chars > 1000)::INT)
            ELSE concat('failed_', d.doc_id) END AS sig FROM documents d LEFT JOIN labels l USING (doc_id)),
          c AS (SELECT lang, source, sig, count(*) AS n FROM g GROUP BY ALL)
        SELECT lang, source, round(max(n) / sum(n), 6) + 0.0 AS r_behavioral, count(*) AS n_signatures FROM c GROUP BY lang, source"""),
    "a13_r_structural": (_structure, """
        WITH c AS (SELECT source, len(string_split(text, chr(10))) AS a, floor(log2(n_chars)) AS b, substr(text, 1, 1) AS h, lang, count(*) AS n FROM documents GROUP BY ALL)
        SELECT source, round(max(n) / sum(n), 6) + 0.0 AS r_structural, count(*) AS n_signatures FROM c GROUP BY source"""),
    "a14_histogram": (lambda s, d: rounded(M.histogram(read(s, d, "documents"), ["lang"], "n_chars")), """
        WITH r AS (SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY lang),
          b AS (SELECT lang, least(floor((n_chars - lo)::DOUBLE / (hi - lo) * 10), 9)::INT AS bin, lo, hi FROM documents JOIN r USING (lang))
        SELECT lang, bin, count(*) AS n, round(lo + (hi - lo)::DOUBLE * bin / 10, 6) + 0.0 AS bin_start FROM b GROUP BY lang, bin, lo, hi"""),
    "a15_across": (lambda s, d: rounded(M.across(_all(s, d).join(_repeat(s, d).select(*GROUP, "r_raw"), GROUP), ["r_raw", "r_anchor_pre", "r_anchor_post"], "r_raw")), sql_round([f"{c}_{f}" for c in ("r_raw", "r_anchor_pre", "r_anchor_post") for f in ("mean", "std", "min", "max")] + ["r_anchor_pre_gain", "r_anchor_post_gain"], f"""
        WITH m AS ({_METRICS_SQL}), r AS (SELECT lang, source, max(n) / sum(n) AS r_raw FROM ({_COUNTS}) GROUP BY lang, source), j AS (SELECT * FROM m JOIN r USING (lang, source))
        SELECT count(*) AS experiments, {', '.join(f'{f}({c}) AS {c}_{n}' for c in ('r_raw', 'r_anchor_pre', 'r_anchor_post') for f, n in (('avg', 'mean'), ('stddev_pop', 'std'), ('min', 'min'), ('max', 'max')))},
          avg(r_anchor_pre - r_raw) AS r_anchor_pre_gain, avg(r_anchor_post - r_raw) AS r_anchor_post_gain FROM j""", ["experiments"])),
    "w8_probability_share": (lambda s, d: rounded(read(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))), "SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) + 0.0 AS p FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)"),
    "s9_metrics_summary": (_summary, f"""
        WITH m AS ({_METRICS_SQL}), r AS (SELECT lang, source, max(n) / sum(n) AS r_raw FROM ({_COUNTS}) GROUP BY lang, source)
        SELECT lang || '_' || source AS experiment_id, 'unknown' AS repo_commit, lang AS contract_id, source AS model, n AS runs,
          round(r_anchor_post - r_anchor_pre, 3) + 0.0 AS "Delta_rescue", round(r_anchor_pre, 3) + 0.0 AS "R_anchor_pre", round(r_anchor_post, 3) + 0.0 AS "R_anchor_post", round(r_raw, 3) + 0.0 AS "R_raw",
          round(mean_distance_pre - mean_distance_post, 3) + 0.0 AS "Delta_mu", round(canon_coverage, 3) + 0.0 AS canon_coverage, round(rescue_rate, 3) + 0.0 AS rescue_rate,
          round(mean_distance_pre, 3) + 0.0 AS mean_distance_pre, round(std_distance_pre, 3) + 0.0 AS std_distance_pre, round(mean_distance_post, 3) + 0.0 AS mean_distance_post, round(std_distance_post, 3) + 0.0 AS std_distance_post,
          {', '.join(f'round("r_repair_at_{k}_{s}", 3) + 0.0 AS "R_repair_at_{str(k).replace(".", "_")}_{s}"' for k in M.TOLERANCES for s in ('pre', 'post'))},
          {', '.join(f'round("r_repair_at_{k}_post" - "r_repair_at_{k}_pre", 3) + 0.0 AS "Delta_P_tau_{str(k).replace(".", "_")}"' for k in M.TOLERANCES)}
        FROM m JOIN r USING (lang, source)"""),
}
