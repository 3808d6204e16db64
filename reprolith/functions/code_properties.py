"""Structural properties of Python source (P1-P15), made in one walk of the syntax tree.

A text that doesn't parse has no properties at all (null). Values with data-dependent keys are arrays of
(key, value) sorted by key, so they compare as values in SQL; dependencies are sorted, which makes them the
same in every process. Hashes of dumps depend on the Python version: don't keep them across versions.
"""

from __future__ import annotations

import ast
import copy
import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names that renaming leaves alone.
FIXED_NAMES = frozenset({"range", "len", "print", "max", "min", "sum", "abs"})
LEVELS = {op: level for level, ops in ((6, "Pow"), (4, "Mult Div FloorDiv Mod"), (3, "Add Sub"), (2, "LShift RShift"), (1, "BitAnd BitXor BitOr")) for op in ops.split()}

PROPERTIES = tuple("""control_flow_signature data_dependency_graph execution_paths function_contracts complexity_class side_effect_profile
termination_properties algebraic_structure numerical_behavior logical_equivalence normalized_ast_structure operator_precedence
statement_ordering recursion_schema""".split())

#: What a walk starts from: counts at 0, flags down, lists empty.
_START = {
    "control_flow_signature": ("if_statements for_loops while_loops nested_depth", "", "function_calls branch_patterns"),
    "execution_paths": ("", "", "execution_paths"),
    "complexity_class": ("nested_loops recursive_calls", "", ""),
    "side_effect_profile": ("", "has_print has_global_access has_file_io modifies_arguments", ""),
    "termination_properties": ("recursive_depth", "has_base_case has_bounded_loops", ""),
    "algebraic_structure": ("", "", "commutative_ops associative_ops binary_operations"),
    "numerical_behavior": ("", "uses_integers uses_floats has_arithmetic", "numeric_constants"),
    "logical_equivalence": ("", "", "boolean_ops comparisons logical_patterns"),
    "statement_ordering": ("", "", "statement_types statement_sequence control_flow_order"),
    "recursion_schema": ("", "is_recursive", "base_cases recursive_calls termination_guards"),
}

SCHEMA = """struct<
control_flow_signature: struct<if_statements:int, for_loops:int, while_loops:int, nested_depth:int, function_calls:array<string>, branch_patterns:array<string>>,
data_dependency_graph: struct<dependencies:array<struct<name:string, uses:array<string>>>, assignments:array<struct<name:string, value:string>>>,
execution_paths: struct<execution_paths:array<array<string>>>,
function_contracts: array<struct<name:string, args:array<string>, has_return:boolean>>,
complexity_class: struct<nested_loops:int, recursive_calls:int, estimated_complexity:string>,
side_effect_profile: struct<has_print:boolean, has_global_access:boolean, has_file_io:boolean, modifies_arguments:boolean, is_pure:boolean>,
termination_properties: struct<has_base_case:boolean, has_bounded_loops:boolean, recursive_depth:int>,
algebraic_structure: struct<commutative_ops:array<string>, associative_ops:array<string>, binary_operations:array<string>>,
numerical_behavior: struct<uses_integers:boolean, uses_floats:boolean, has_arithmetic:boolean, numeric_constants:array<string>>,
logical_equivalence: struct<boolean_ops:array<string>, comparisons:array<string>, logical_patterns:array<string>>,
normalized_ast_structure: struct<node_types:array<string>, ast_depth:int, ast_hash:string, alpha_renamed_hash:string>,
operator_precedence: struct<operator_sequence:array<string>, precedence_levels:array<struct<op:string, level:int>>>,
statement_ordering: struct<statement_types:array<string>, statement_sequence:array<string>, control_flow_order:array<string>>,
recursion_schema: struct<is_recursive:boolean, recursion_pattern:string, base_cases:array<struct<condition:string, return_type:string>>, recursive_calls:array<struct<num_args:int, arg_patterns:array<string>>>, termination_guards:array<string>>
>""".replace("\n", " ")


def _digest(tree: ast.AST) -> str:
    return hashlib.md5(ast.dump(tree, annotate_fields=False).encode()).hexdigest()


def renamed(tree: ast.AST) -> ast.AST:
    """Parameters as p0, p1, ..., other names as v0, v1, ... in order of appearance."""
    tree = copy.deepcopy(tree)
    names: dict[str, str] = {}
    counts = {"p": 0, "v": 0}

    def name(old: str, kind: str) -> str:
        if old not in names:
            names[old] = f"{kind}{counts[kind]}"
            counts[kind] += 1
        return names[old]

    def walk(node: ast.AST) -> None:
        params = node.args.args if isinstance(node, ast.FunctionDef) else []
        for a in params:
            name(a.arg, "p")
        if isinstance(node, ast.Name) and node.id not in FIXED_NAMES:
            node.id = name(node.id, "v")
        for child in ast.iter_child_nodes(node):
            walk(child)
        for a in params:
            a.arg = names.get(a.arg, a.arg)

    walk(tree)
    return tree


def _uses(node: ast.AST) -> set[str]:
    if isinstance(node, ast.Name):
        return {node.id}
    parts = [node.left, node.right] if isinstance(node, ast.BinOp) else node.args if isinstance(node, ast.Call) else []
    return set().union(*map(_uses, parts)) if parts else set()


def _number(v: float) -> str:
    """One text for equal numbers, whatever their type."""
    return str(int(v)) if v == v and v not in (float("inf"), float("-inf")) and v == int(v) else repr(float(v))


class _Walk:
    """One pre-order walk; every property reads the nodes as they come by."""

    def __init__(self) -> None:
        self.p: dict = {k: dict.fromkeys(n.split(), 0) | dict.fromkeys(f.split(), False) | {x: [] for x in lists.split()} for k, (n, f, lists) in _START.items()}
        self.p["side_effect_profile"]["is_pure"] = True
        self.p["recursion_schema"]["recursion_pattern"] = None
        self.types: list[str] = []
        self.deepest = 0
        self.uses: dict[str, set[str]] = {}
        self.values: dict[str, str] = {}
        self.contracts: dict[str, dict] = {}
        self.defined: set[str] = set()

    def visit(self, node: ast.AST, depth: int = 0, block: int = 0, loops: int = 0, path: tuple[str, ...] = (), function: str | None = None) -> None:
        kind, p = type(node).__name__, self.p
        self.types.append(kind)
        self.deepest = max(self.deepest, depth)
        flow, order = p["control_flow_signature"], p["statement_ordering"]
        if isinstance(node, ast.stmt):
            order["statement_sequence"].append(f"{kind}_{len(order['statement_types'])}")
            order["statement_types"].append(kind)
            if kind in ("If", "For", "While", "FunctionDef"):
                order["control_flow_order"].append(kind)
        match node:
            case ast.If() | ast.For() | ast.While():
                flow[{"If": "if_statements", "For": "for_loops", "While": "while_loops"}[kind]] += 1
                if kind == "If":
                    flow["branch_patterns"].append(f"if_at_depth_{block}")
                    p["termination_properties"]["has_base_case"] |= any(isinstance(x, ast.Return) for x in ast.walk(node))
                else:
                    loops += 1
                    p["complexity_class"]["nested_loops"] = max(loops, p["complexity_class"]["nested_loops"])
                p["termination_properties"]["has_bounded_loops"] |= kind == "For"
                block += 1
                flow["nested_depth"] = max(block, flow["nested_depth"])
                if kind != "While":
                    path = (*path, "branch" if kind == "If" else "loop")
                    p["execution_paths"]["execution_paths"].append(list(path))
            case ast.FunctionDef():
                self._function(node)
                path, function = (*path, f"function_{node.name}"), node.name
                p["execution_paths"]["execution_paths"].append(list(path))
            case ast.Call(func=ast.Name(id=called)):
                self._call(node, called, function)
            case ast.Assign():
                for name in (t.id for t in node.targets if isinstance(t, ast.Name)):
                    self.uses.setdefault(name, set()).update(_uses(node.value))
                    self.values[name] = ast.dump(node.value)
            case ast.Global():
                p["side_effect_profile"] |= {"has_global_access": True, "is_pure": False}
            case ast.BinOp():
                op = type(node.op).__name__
                p["numerical_behavior"]["has_arithmetic"] = True
                for name, wanted in (("binary_operations", True), ("commutative_ops", op in ("Add", "Mult")), ("associative_ops", op in ("Add", "Mult"))):
                    if wanted:
                        p["algebraic_structure"][name].append(op)
            case ast.BoolOp():
                p["logical_equivalence"]["boolean_ops"].append(type(node.op).__name__)
            case ast.Compare():
                p["logical_equivalence"]["comparisons"] += [type(op).__name__ for op in node.ops]
            case ast.Constant(value=int() | float() as v):
                p["numerical_behavior"]["uses_integers" if isinstance(v, int) else "uses_floats"] = True
                p["numerical_behavior"]["numeric_constants"].append(_number(v))
        for child in ast.iter_child_nodes(node):
            self.visit(child, depth + 1, block, loops, path, function)

    def _function(self, node: ast.FunctionDef) -> None:
        self.defined.add(node.name)
        self.contracts[node.name] = {"name": node.name, "args": [a.arg for a in node.args.args], "has_return": any(isinstance(x, ast.Return) for x in ast.walk(node))}
        schema = self.p["recursion_schema"]
        for branch in (s for s in node.body if isinstance(s, ast.If)):
            for leave in (s for s in branch.body if isinstance(s, ast.Return)):
                condition = ast.unparse(branch.test)
                schema["base_cases"].append({"condition": condition, "return_type": "constant" if isinstance(leave.value, ast.Constant) else "expression"})
                schema["termination_guards"].append(condition)

    def _call(self, node: ast.Call, called: str, function: str | None) -> None:
        p = self.p
        p["control_flow_signature"]["function_calls"].append(called)
        p["complexity_class"]["recursive_calls"] += called in self.defined
        for flag, names in (("has_print", ("print", "input")), ("has_file_io", ("open", "read", "write"))):
            if called in names:
                p["side_effect_profile"] |= {flag: True, "is_pure": False}
        if function is not None and called == function:
            p["recursion_schema"]["is_recursive"] = True
            p["recursion_schema"]["recursive_calls"].append(dict(num_args=len(node.args), arg_patterns=[type(a).__name__ for a in node.args]))


def extract(code: str | None) -> dict | None:
    """All properties of a text, or None if it doesn't parse."""
    try:
        tree = ast.parse(code)
        w = _Walk()
        w.visit(tree)
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
        return None
    p = w.p
    complexity, schema = p["complexity_class"], p["recursion_schema"]
    complexity["estimated_complexity"] = "O(2^n)" if complexity["recursive_calls"] else ("O(1)", "O(n)", "O(n^2)")[min(complexity["nested_loops"], 2)]
    if schema["is_recursive"]:
        calls = len(schema["recursive_calls"])
        schema["recursion_pattern"] = "multi-way" if calls > 2 else "linear" if calls == 1 else "divide_and_conquer" if schema["base_cases"] else "binary"
    p["data_dependency_graph"] = {"dependencies": [{"name": k, "uses": sorted(v)} for k, v in sorted(w.uses.items())], "assignments": [{"name": k, "value": v} for k, v in sorted(w.values.items())]}
    p["function_contracts"] = [w.contracts[k] for k in sorted(w.contracts)]
    ops = p["algebraic_structure"]["binary_operations"]
    p["operator_precedence"] = {"operator_sequence": list(ops), "precedence_levels": [{"op": o, "level": LEVELS.get(o, 0)} for o in sorted(set(ops))]}
    p["normalized_ast_structure"] = {"node_types": w.types, "ast_depth": w.deepest, "ast_hash": _digest(tree), "alpha_renamed_hash": _digest(renamed(tree))}
    return {k: p[k] for k in PROPERTIES}


@F.pandas_udf(StringType())
def properties_json(code: pd.Series) -> pd.Series:
    return pd.Series([None if (p := extract(c)) is None else json.dumps(p) for c in code], dtype=object)


def properties(code: Column) -> Column:
    """The typed struct of all properties; null for a text that doesn't parse."""
    return F.from_json(properties_json(code), SCHEMA)


def with_properties(df: DataFrame, code: str, name: str = "props") -> DataFrame:
    """`df` with the properties of a column of code, made once for each distinct text.

    Distinct texts meet by digest with partial aggregation, so a text that many rows share is parsed once;
    the join back is by digest, and left to Spark's skew handling.
    """
    keyed = df.withColumn("__code", F.sha2(F.col(code).cast("binary"), 256))
    once = keyed.groupBy("__code").agg(F.any_value(code).alias("__text")).select("__code", properties(F.col("__text")).alias(name))
    return keyed.join(once, "__code", "left").drop("__code")
