"""The table of rewrite rules, mismatches of properties, and the selection of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rule, the property it serves, the mismatch it answers, its class, its priority
RULES = (
    ("len_zero_to_not", "logical_equivalence", "empty_check", "equivalent", 2),
    ("boolean_redundancy", "logical_equivalence", "boolean_redundancy", "equivalent", 2),
    ("ternary", "control_flow_signature", "ternary_opportunity", "equivalent", 1),
    ("append_loop", "normalized_ast_structure", "loop_to_comprehension", "equivalent", 3),
    ("concat_loop", "normalized_ast_structure", "string_building", "equivalent", 3),
    ("inline_return", "statement_ordering", "return_statement_style", "equivalent", 2),
)
#: mismatch, property, its severity, and the condition on the two structs
MISMATCHES = (
    ("ternary_opportunity", "control_flow_signature", 0.20, lambda a, b: a["if_statements"] != b["if_statements"]),
    ("loop_to_comprehension", "control_flow_signature", 0.30, lambda a, b: (a["for_loops"] != b["for_loops"]) | (a["while_loops"] != b["while_loops"])),
    ("return_statement_style", "statement_ordering", 0.15, lambda a, b: a["statement_types"] != b["statement_types"]),
    ("boolean_redundancy", "logical_equivalence", 0.10, lambda a, b: a["boolean_ops"] != b["boolean_ops"]),
    ("empty_check", "logical_equivalence", 0.15, lambda a, b: a["comparisons"] != b["comparisons"]),
    ("string_building", "algebraic_structure", 0.20, lambda a, b: a["binary_operations"] != b["binary_operations"]),
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, property string, mismatch string, semantic_class string, priority int")


def rule_statistics(table: DataFrame) -> DataFrame:
    """Rules by priority, property and mismatch."""
    one = [table.groupBy(F.lit(c).alias("by"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")) for c in ("priority", "property", "mismatch")]
    return one[0].unionByName(one[1]).unionByName(one[2])


def mismatches(a: Column, b: Column) -> Column:
    """Array of (mismatch, property, severity) between a code's properties and the canon's."""
    rows = [F.struct(F.lit(m).alias("mismatch"), F.lit(p).alias("property"), F.lit(s).alias("severity"), F.coalesce(test(a[p], b[p]), F.lit(False)).alias("there")) for m, p, s, test in MISMATCHES]
    return F.transform(F.filter(F.array(*rows), lambda r: r["there"]), lambda r: F.struct(r["mismatch"].alias("mismatch"), r["property"].alias("property"), r["severity"].alias("severity")))


def total_severity(m: Column, least: float = 0.0) -> Column:
    """A37."""
    return F.aggregate(F.filter(m, lambda r: r["severity"] >= least), F.lit(0.0), lambda s, r: s + r["severity"])


def confidence(priority: Column, severity: Column) -> Column:
    """M12."""
    return F.least(F.lit(1.0), 0.5 + 0.1 * priority + 0.3 * severity)


def select_rules(found: DataFrame, key: str, table: DataFrame, least: float = 0.5, top: int | None = None) -> DataFrame:
    """Of (key, mismatch, severity) rows, the best rule for each mismatch by priority x confidence.

    Results of a key are numbered by priority, confidence and severity, all descending; `top` keeps the first.
    The rule table has a fixed handful of rows and is sent to every executor.
    """
    met = found.join(F.broadcast(table), "mismatch").withColumn("confidence", confidence(F.col("priority"), F.col("severity")))
    met = met.filter(F.col("confidence") >= least)
    best = met.groupBy(key, "mismatch").agg(F.max_by(F.struct("rule", "priority", "confidence", "severity"), F.struct(F.col("priority") * F.col("confidence"), F.col("rule"))).alias("b")).select(key, "mismatch", "b.*")
    # a key has at most one row for each kind of mismatch: sort within one small array
    order = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("a"), (-F.col("confidence")).alias("b"), (-F.col("severity")).alias("c"), "rule", "mismatch")))
    out = best.groupBy(key).agg(order.alias("r")).select(key, F.posexplode("r").alias("place", "x")).select(key, "place", "x.rule", "x.mismatch", (-F.col("x.b")).alias("confidence"))
    return out if top is None else out.filter(F.col("place") < top)
