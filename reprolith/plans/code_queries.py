"""Queries of code operators on source made from orders: five templates with numbers put in, so results are known."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from ..functions import compliance as C
from ..functions import distance as D
from ..functions import text as X
from ..functions.code_properties import PROPERTIES, properties
from ..functions.oracles import tested_codes
from ..functions.rewrite import pipeline_column, repair_column
from ..operators import rules as RU
from ..streaming import windows as S
from .common import Query, read, rounded

TEMPLATES = (
    "def f(n):\n    return n + %s",
    "def f(n):\n    total = 0\n    for i in range(n):\n        total += i * %s\n    return total",
    "def f(n):\n    if n <= 1:\n        return %s\n    return f(n - 1) + f(n - 2)",
    "def f(n):\n    x = %s\n    while n > 0:\n        x = x + n\n        n = n - 1\n    print(x)\n    return x",
    "def f(n) return %s",
)
_T, _K = "(o_orderkey % 5)", "(o_orderkey % 7)"


def _code(s, d):
    """(o_orderkey, t, k, code); code is template t with k in it."""
    o = read(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("t"), (F.col("o_orderkey") % 7).cast("int").alias("k"))
    templates = F.array(*(F.lit(t) for t in TEMPLATES))
    return o.withColumn("code", F.replace(F.element_at(templates, F.col("t") + 1), F.lit("%s"), F.col("k").cast("string")))


def _distinct(s, d):
    """The 35 distinct codes; Python works on these, and results are joined back by (t, k)."""
    return _code(s, d).groupBy("t", "k").agg(F.any_value("code").alias("code"))


def _props(s, d):
    return _distinct(s, d).withColumn("p", properties(F.col("code")))


def _each(s, d, df):
    """The results of each order's code; integers that a code has none of are -1."""
    df = df.select(*(F.coalesce(c, F.lit(-1)).alias(c) if t == "int" else c for c, t in df.dtypes))
    return _code(s, d).drop("code").join(df, ["t", "k"]).drop("t", "k")


def _case(*values: object) -> str:
    return f"CASE {_T} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _sql(**columns: tuple) -> str:
    known = {c: [-1 if x == "NULL" and isinstance(v[0], int) else x for x in v] for c, v in columns.items()}
    return "SELECT o_orderkey, " + ", ".join(f"{_case(*v)} AS {c}" for c, v in known.items()) + " FROM orders"


def _q(**fields: str):
    return lambda s, d: _each(s, d, _props(s, d).select("t", "k", *(F.expr(f"p.{v}").alias(c) for c, v in fields.items())))


def _size(**fields: str):
    return lambda s, d: _each(s, d, _props(s, d).select("t", "k", *(F.when(F.col("p").isNotNull(), F.size(F.col(f"p.{v}"))).alias(c) for c, v in fields.items())))


def _distances(s, d):
    """Each code against template 2 with 1, the canon."""
    p = _props(s, d)
    canon = p.filter("t = 2 and k = 1").select(F.col("p").alias("c"), F.col("code").alias("canon"))  # one row
    return p.join(F.broadcast(canon))


def _oracle_tests(s, d):
    cases = json.dumps([{"input": n, "expected": v} for n, v in ((0, 1), (1, 1), (4, 5))])
    c = _distinct(s, d).withColumns({"family": F.lit("factorial"), "cases": F.lit(cases), "named": F.regexp_replace("code", r"\bf\(", "factorial(")})
    got = tested_codes(c, "named", "family", "cases", seconds=20.0).select("digest", "passed_tests")
    return _each(s, d, c.withColumn("digest", F.sha2(F.col("named").cast("binary"), 256)).join(got, "digest").select("t", "k", "passed_tests"))


#: how many of f(0)=1, f(1)=1, f(4)=5 hold
_PASSED = f"CASE {_T} WHEN 0 THEN CASE {_K} WHEN 1 THEN 2 WHEN 0 THEN 1 ELSE 0 END WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN {_K} = 1 THEN 3 ELSE 0 END WHEN 3 THEN CASE {_K} WHEN 1 THEN 1 WHEN 0 THEN 1 ELSE 0 END ELSE 0 END"


def _repaired(s, d):
    c = _distinct(s, d)
    canon = TEMPLATES[2] % 1
    cases = json.dumps([{"input": n, "expected": v} for n, v in ((0, 1), (4, 5))])
    named = lambda x: x.replace("f(", "factorial(")
    r = repair_column(F.regexp_replace("code", r"\bf\(", "factorial("), F.lit(named(canon)), F.lit("factorial"), F.lit("factorial"), F.lit(cases), 20.0)
    return c.withColumn("r", r).select("t", "k", F.col("r.level").alias("level"), F.col("r.success").alias("success"))


def _severities(**severe: str) -> str:
    """property:severity of each property that differs, in the order of the distance."""
    short = {"m": "moderate", "M": "major", "s": "minor"}
    return "'" + ",".join(f"{p}:{short[x]}" for p, x in severe.items()) + "'"


#: How each template differs from template 2 with 1; tests hold these against the plain functions.
_DIFFERENCES = (
    _severities(control_flow_signature="m", execution_paths="M", complexity_class="m", termination_properties="m", algebraic_structure="m", numerical_behavior="s", logical_equivalence="m", normalized_ast_structure="M", operator_precedence="M", statement_ordering="M", recursion_schema="M"),
    _severities(control_flow_signature="m", data_dependency_graph="M", execution_paths="M", complexity_class="M", termination_properties="m", algebraic_structure="M", numerical_behavior="s", logical_equivalence="m", normalized_ast_structure="M", operator_precedence="M", statement_ordering="M", recursion_schema="M"),
    f"CASE WHEN {_K} = 1 THEN '' ELSE 'numerical_behavior:minor,normalized_ast_structure:major' END",
    _severities(control_flow_signature="m", data_dependency_graph="M", execution_paths="M", complexity_class="M", side_effect_profile="m", termination_properties="m", algebraic_structure="m", numerical_behavior="s", logical_equivalence="m", normalized_ast_structure="M", operator_precedence="m", statement_ordering="M", recursion_schema="M"),
    "'" + ",".join(f"{p}:major" for p in PROPERTIES) + "'",
)


def _stream(s, d):
    """The events as a stream through tumbling windows into memory, to its end."""
    folder = tempfile.mkdtemp(prefix="stream-")
    spark = s
    rows = spark.readStream.schema(read(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = S.windowed(rows.withColumn("ts", F.col("ts").cast("timestamp")), late="10 days")
    name = "x3_" + folder.rsplit("-", 1)[1].replace("_", "")
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return rounded(spark.table(name).select(F.col("window_start").cast("date").cast("string").alias("day"), "event_type", "n", "mean"))


QUERIES: dict[str, Query] = {
    "p1_control_flow": (_q(ifs="control_flow_signature.if_statements", fors="control_flow_signature.for_loops", whiles="control_flow_signature.while_loops", depth="control_flow_signature.nested_depth"), _sql(ifs=(0, 0, 1, 0, "NULL"), fors=(0, 1, 0, 0, "NULL"), whiles=(0, 0, 0, 1, "NULL"), depth=(0, 1, 1, 1, "NULL"))),
    "p2_dependencies": (_size(dependencies="data_dependency_graph.dependencies", assignments="data_dependency_graph.assignments"), _sql(dependencies=(0, 1, 0, 2, "NULL"), assignments=(0, 1, 0, 2, "NULL"))),
    "p3_paths": (_size(paths="execution_paths.execution_paths"), _sql(paths=(1, 2, 2, 1, "NULL"))),
    "p4_contracts": (_q(name="function_contracts[0].name", has_return="function_contracts[0].has_return"), _sql(name=("'f'", "'f'", "'f'", "'f'", "NULL"), has_return=("true", "true", "true", "true", "NULL"))),
    "p5_complexity": (_q(complexity="complexity_class.estimated_complexity", calls="complexity_class.recursive_calls"), _sql(complexity=("'O(1)'", "'O(n)'", "'O(2^n)'", "'O(n)'", "NULL"), calls=(0, 0, 2, 0, "NULL"))),
    "p6_side_effects": (_q(has_print="side_effect_profile.has_print", is_pure="side_effect_profile.is_pure"), _sql(has_print=("false", "false", "false", "true", "NULL"), is_pure=("true", "true", "true", "false", "NULL"))),
    "p7_termination": (_q(base="termination_properties.has_base_case", bounded="termination_properties.has_bounded_loops"), _sql(base=("false", "false", "true", "false", "NULL"), bounded=("false", "true", "false", "false", "NULL"))),
    "p8_algebra": (_size(operations="algebraic_structure.binary_operations", commutative="algebraic_structure.commutative_ops"), _sql(operations=(1, 1, 3, 2, "NULL"), commutative=(1, 1, 1, 1, "NULL"))),
    "p9_numbers": (_size(constants="numerical_behavior.numeric_constants"), _sql(constants=(1, 2, 4, 3, "NULL"))),
    "p10_logic": (_size(comparisons="logical_equivalence.comparisons", booleans="logical_equivalence.boolean_ops"), _sql(comparisons=(0, 0, 1, 1, "NULL"), booleans=(0, 0, 0, 0, "NULL"))),
    "p11_ast": (lambda s, d: _each(s, d, _props(s, d).select("t", "k", (F.col("p.normalized_ast_structure.ast_hash") == F.first("p.normalized_ast_structure.ast_hash").over(_by_t())).alias("same_as_0"), F.col("p.normalized_ast_structure.ast_depth").alias("depth"))), f"SELECT o_orderkey, CASE WHEN {_T} = 4 THEN NULL ELSE {_K} = 0 END AS same_as_0, {_case(5, 6, 7, 6, -1)} AS depth FROM orders"),
    "p13_precedence": (_q(op="operator_precedence.precedence_levels[0].op", level="operator_precedence.precedence_levels[0].level"), _sql(op=("'Add'", "'Mult'", "'Add'", "'Add'", "NULL"), level=(3, 4, 3, 3, "NULL"))),
    "p14_statements": (lambda s, d: _each(s, d, _props(s, d).select("t", "k", F.array_join("p.statement_ordering.statement_types", ",").alias("statements"))), _sql(statements=("'FunctionDef,Return'", "'FunctionDef,Assign,For,AugAssign,Return'", "'FunctionDef,If,Return,Return'", "'FunctionDef,Assign,While,Assign,Assign,Expr,Return'", "NULL"))),
    "p15_recursion": (_q(recursive="recursion_schema.is_recursive", pattern="recursion_schema.recursion_pattern"), _sql(recursive=("false", "false", "true", "false", "NULL"), pattern=("NULL", "NULL", "'divide_and_conquer'", "NULL", "NULL"))),
    "d2_unparsed": (lambda s, d: _each(s, d, _distances(s, d).select("t", "k", D.total_distance(F.col("p"), F.lit(None).cast(_type())).alias("to_nothing"))), _sql(to_nothing=("1.0::DOUBLE", "1.0", "1.0", "1.0", "0.0"))),
    "d3_control_flow": (lambda s, d: rounded(_each(s, d, _distances(s, d).select("t", "k", D.property_distance("control_flow_signature", F.col("p"), F.col("c")).alias("d")))), _sql(d=("0.5::DOUBLE", "0.5", "0.0", "0.5", "1.0"))),
    "d4_ast": (lambda s, d: _each(s, d, _distances(s, d).select("t", "k", D.property_distance("normalized_ast_structure", F.col("p"), F.col("c"), True).alias("d"))), f"SELECT o_orderkey, CASE WHEN {_T} = 2 AND {_K} = 1 THEN 0.0::DOUBLE ELSE 1.0 END AS d FROM orders"),
    "d5_recursion": (lambda s, d: _each(s, d, _distances(s, d).select("t", "k", D.property_distance("recursion_schema", F.col("p"), F.col("c")).alias("d"))), _sql(d=("1.0::DOUBLE", "1.0", "0.0", "1.0", "1.0"))),
    "d1_total": (lambda s, d: rounded(_each(s, d, _distances(s, d).select("t", "k", D.total_distance(F.col("p"), F.col("c")).alias("d")))), f"SELECT o_orderkey, CASE {_T} WHEN 0 THEN 0.529762 WHEN 1 THEN 0.696429 WHEN 2 THEN CASE WHEN {_K} = 1 THEN 0.0 ELSE 0.089286 END WHEN 3 THEN 0.617857 ELSE 1.0 END::DOUBLE AS d FROM orders"),
    "d9_differences": (lambda s, d: _each(s, d, _distances(s, d).select("t", "k", F.array_join(F.transform(D.differences(F.col("p"), F.col("c")), lambda r: F.concat(r["property"], F.lit(":"), r["severity"])), ",").alias("differences"))), f"SELECT o_orderkey, CASE {_T} {' '.join(f'WHEN {t} THEN {x}' for t, x in enumerate(_DIFFERENCES))} END AS differences FROM orders"),
    "c1_compliance": (lambda s, d: _each(s, d, _distinct(s, d).select("t", "k", F.size(C.violations_column(F.col("code"), ("print(",), ("return",), ("misra_15_5", "misra_17_2"))).alias("violations"))), _sql(violations=(0, 0, 3, 1, 1))),
    "c8_first_violation": (lambda s, d: _each(s, d, _distinct(s, d).select("t", "k", C.first_violation(F.col("code"), ("print(",), ("total",), "f").alias("first"))), _sql(first=("'missing: total'", "NULL", "'missing: total'", "'forbidden: print('", "'missing: total'"))),
    "c11_guard_removed": (lambda s, d: _each(s, d, _distinct(s, d).select("t", "k", C.domain_guard_removed(F.concat(F.lit("raise "), F.col("code")), F.col("code"), F.lit("n >= 0")).alias("removed"))), _sql(removed=("true", "true", "true", "true", "true"))),
    "r11_oracle": (_oracle_tests, f"SELECT o_orderkey, {_PASSED} AS passed_tests FROM orders"),
    "m1_repair": (lambda s, d: _each(s, d, _repaired(s, d)), f"SELECT o_orderkey, CASE {_T} WHEN 2 THEN 0 WHEN 4 THEN -1 ELSE 3 END AS level, {_T} < 4 AS success FROM orders"),
    "m29_pipeline": (lambda s, d: _each(s, d, _distinct(s, d).withColumn("r", pipeline_column(F.concat(F.lit("def g(n):\n    y = n * "), F.col("k").cast("string"), F.lit("\n    return y")), F.lit("def g(n):\n    return n * 3"))).select("t", "k", F.array_join("r.applied", ",").alias("applied"), F.regexp_extract("r.code", r"return (.*)$", 1).alias("returned"))), f"SELECT o_orderkey, 'inline_return' AS applied, 'n * ' || {_K} AS returned FROM orders"),
    "a35_property_sizes": (_size(nodes="normalized_ast_structure.node_types"), _sql(nodes=(10, 28, 31, 40, "NULL"))),
    "a36_rule_statistics": (lambda s, d: RU.rule_statistics(RU.rules(s)), "SELECT * FROM (VALUES ('priority', '1', 1), ('priority', '2', 3), ('priority', '3', 2), ('property', 'logical_equivalence', 2), ('property', 'control_flow_signature', 1), ('property', 'normalized_ast_structure', 2), ('property', 'statement_ordering', 1), ('mismatch', 'empty_check', 1), ('mismatch', 'boolean_redundancy', 1), ('mismatch', 'ternary_opportunity', 1), ('mismatch', 'loop_to_comprehension', 1), ('mismatch', 'string_building', 1), ('mismatch', 'return_statement_style', 1)) v(\"by\", value, n)"),
    "m11_mismatches": (lambda s, d: rounded(_each(s, d, _distances(s, d).select("t", "k", RU.total_severity(RU.mismatches(F.col("p"), F.col("c"))).alias("severity")))), _sql(severity=("0.7::DOUBLE", "1.0", "0.0", "1.0", "0.0"))),
    "o4_selected_rules": (lambda s, d: _each(s, d, RU.select_rules(_distances(s, d).select(F.struct("t", "k").alias("key"), F.explode(RU.mismatches(F.col("p"), F.col("c"))).alias("m")).select("key", "m.mismatch", "m.severity"), "key", RU.rules(s)).filter("place = 0").select("key.t", "key.k", "rule")), f"SELECT o_orderkey, CASE {_T} WHEN 0 THEN 'concat_loop' ELSE 'append_loop' END AS rule FROM orders WHERE {_T} IN (0, 1, 3)"),
    "x3_stream_windows": (_stream, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1, 2"),
    "l1_fenced_code": (lambda s, d: _each(s, d, _distinct(s, d).select("t", "k", X.fenced_code(F.concat(F.lit("Here:\n```python\n"), F.col("code"), F.lit("\n```\nDone"))).alias("out"))), "SELECT o_orderkey, replace(" + _case(*("'" + t.replace("\n", "@") + "'" for t in TEMPLATES)).replace("%s", "#") + f", '@', chr(10)).replace('#', {_K}::VARCHAR) AS out FROM orders"),
}


def _by_t():
    from pyspark.sql import Window

    return Window.partitionBy("t").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _type() -> str:
    from ..functions.code_properties import SCHEMA

    return SCHEMA
