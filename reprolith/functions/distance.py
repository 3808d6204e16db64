"""Distances between property structs (D1-D10, D13, D14): column expressions, and the same on plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .code_properties import PROPERTIES, extract

_FLOW = ("if_statements", "for_loops", "while_loops", "nested_depth")
_FIELDS = {
    "data_dependency_graph": ("dependencies", "assignments"),
    "execution_paths": ("execution_paths",),
    "complexity_class": ("nested_loops", "recursive_calls", "estimated_complexity"),
    "side_effect_profile": ("has_print", "has_global_access", "has_file_io", "modifies_arguments", "is_pure"),
    "termination_properties": ("has_base_case", "has_bounded_loops", "recursive_depth"),
    "algebraic_structure": ("commutative_ops", "associative_ops", "binary_operations"),
    "numerical_behavior": ("uses_integers", "uses_floats", "has_arithmetic", "numeric_constants"),
    "logical_equivalence": ("boolean_ops", "comparisons", "logical_patterns"),
    "operator_precedence": ("operator_sequence", "precedence_levels"),
    "statement_ordering": ("statement_types", "statement_sequence", "control_flow_order"),
}


def _gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def _differs(a: Column, b: Column) -> Column:
    return (~a.eqNullSafe(b)).cast("double")


def _mean(*columns: Column) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / len(columns)


def property_distance(name: str, a: Column, b: Column, strict: Column | bool = False) -> Column:
    """D2-D7 for one property of two structs; `strict` compares names too."""
    x, y = a[name], b[name]
    if name == "control_flow_signature":
        d = _mean(*(_gap(x[f], y[f]) for f in _FLOW))
    elif name == "normalized_ast_structure":
        strict = F.lit(strict) if isinstance(strict, bool) else strict
        d = F.when(strict, _differs(x["ast_hash"], y["ast_hash"])).otherwise(_differs(x["alpha_renamed_hash"], y["alpha_renamed_hash"]))
    elif name == "recursion_schema":
        sizes = [_gap(F.size(x[f]), F.size(y[f])) for f in ("base_cases", "recursive_calls")]
        d = F.when(x["is_recursive"] != y["is_recursive"], 1.0).when(~x["is_recursive"], 0.0).otherwise(_mean(_differs(x["recursion_pattern"], y["recursion_pattern"]), *sizes))
    elif name == "function_contracts":
        names = F.size(F.array_union(x["name"], y["name"]))
        d = F.coalesce(F.try_divide((names - F.size(F.array_intersect(x, y))).cast("double"), names.cast("double")), F.lit(0.0))
    else:
        d = _mean(*(_differs(x[f], y[f]) for f in _FIELDS[name]))
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 1.0).otherwise(d)


def total_distance(a: Column, b: Column, strict: Column | bool = False) -> Column:
    """Mean over the properties; two texts that don't parse are at 0."""
    return _mean(*(property_distance(n, a, b, strict) for n in PROPERTIES))


def severity_of(d: Column) -> Column:
    """F20."""
    return F.when(d == 0, "none").when(d < 0.3, "minor").when(d < 0.7, "moderate").otherwise("major")


def differences(a: Column, b: Column) -> Column:
    """Array of (property, distance, severity) where the values differ; names never count."""
    rows = []
    for n in PROPERTIES:
        d = property_distance(n, a, b)
        rows.append(F.struct(F.lit(n).alias("property"), d.alias("distance"), severity_of(d).alias("severity"), (~a[n].eqNullSafe(b[n])).alias("differs")))
    kept = F.filter(F.array(*rows), lambda r: r["differs"])
    return F.transform(kept, lambda r: F.struct(r["property"].alias("property"), r["distance"].alias("distance"), r["severity"].alias("severity")))


def ad_hoc_distance(a: Column, b: Column, numeric: bool) -> Column:
    """|a - b| of numbers, else 0 or 1."""
    return F.abs(a - b) if numeric else _differs(a, b)


def normalised_levenshtein(a: Column, b: Column) -> Column:
    """Edits over the longer length; 0 for two empty texts."""
    return F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double")), F.lit(0.0))


def distance_of(p: dict | None, q: dict | None, strict: bool = False) -> float:
    """D1 of two values of `extract`."""
    if p is None or q is None:
        return float((p is None) != (q is None))
    total = 0.0
    for n in PROPERTIES:
        x, y = p[n], q[n]
        if n == "control_flow_signature":
            total += sum(abs(x[f] - y[f]) / max(x[f], y[f], 1) for f in _FLOW) / len(_FLOW)
        elif n == "normalized_ast_structure":
            total += float(x["ast_hash"] != y["ast_hash"] if strict else x["alpha_renamed_hash"] != y["alpha_renamed_hash"])
        elif n == "function_contracts":
            names = {c["name"] for c in x} | {c["name"] for c in y}
            total += (len(names) - sum(c in y for c in x)) / len(names) if names else 0.0
        elif n == "recursion_schema":
            if x["is_recursive"] != y["is_recursive"]:
                total += 1
            elif x["is_recursive"]:
                sizes = [(len(x[f]), len(y[f])) for f in ("base_cases", "recursive_calls")]
                total += (float(x["recursion_pattern"] != y["recursion_pattern"]) + sum(abs(i - j) / max(i, j, 1) for i, j in sizes)) / 3
        else:
            fields = _FIELDS[n]
            total += sum(x[f] != y[f] for f in fields) / len(fields)
    return total / len(PROPERTIES)


def code_distance(a: str, b: str, strict: bool = False) -> float:
    return distance_of(extract(a), extract(b), strict)
