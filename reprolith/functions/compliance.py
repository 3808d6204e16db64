"""Contract compliance of code (C1-C8, C10-C13): substrings on the JVM, structural rules from one parse."""

from __future__ import annotations

import ast
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .oracles import OutOfDomain, passes_in_domain
from .sandbox import Sandbox

#: Structural rules by id, with what they forbid.
RULES = {
    "misra_15_4": "break or continue",
    "misra_15_5": "more than one exit of a function",
    "misra_17_2": "direct recursion",
    "misra_21_3": "library containers",
    "p10_1": "direct recursion",
    "p10_2": "loops without a fixed bound",
    "p10_3": "library containers",
    "p10_4": "functions of more than 60 lines",
    "p10_5": "functions without an assertion",
    "p10_6": "global data",
}


def violations(code: str | None, rules: Sequence[str] = ("misra_15_4", "misra_15_5", "misra_17_2", "misra_21_3")) -> list[str]:
    """A line for each breach of the named rules, in order of the rules; a syntax error is one breach."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, TypeError):
        return ["syntax error"]
    nodes = list(ast.walk(tree))
    functions = [n for n in nodes if isinstance(n, ast.FunctionDef)]
    out: list[str] = []
    for rule in rules:
        if rule == "misra_15_5":
            for f in functions:
                exits = sum(isinstance(n, ast.Return) for n in ast.walk(f))
                out += [f"{rule}: {f.name} has {exits} exits"] if exits > 1 else []
            out += [f"{rule}: return inside if" for n in nodes if isinstance(n, ast.If) and any(isinstance(s, ast.Return) for s in n.body)]
        elif rule == "misra_15_4":
            out += [f"{rule}: {type(n).__name__.lower()}" for n in nodes if isinstance(n, (ast.Break, ast.Continue))]
        elif rule in ("misra_17_2", "p10_1"):
            out += [f"{rule}: {f.name} calls itself" for f in functions if f.name in _called(f)]
        elif rule in ("misra_21_3", "p10_3"):
            out += [f"{rule}: imports collections" for n in nodes if isinstance(n, ast.ImportFrom) and n.module == "collections" or isinstance(n, ast.Import) and any(a.name == "collections" for a in n.names)]
    return out


def _called(tree: ast.AST) -> set[str]:
    return {c.func.id for c in ast.walk(tree) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)}


def compliance(code: str, forbidden: Sequence[str] = (), required: Sequence[str] = (), rules: Sequence[str] = ()) -> tuple[bool, list[str]]:
    """Forbidden substrings, required ones, then structural rules; compliant if none is broken."""
    found = [f"forbidden: {x}" for x in forbidden if x in code] + [f"missing: {x}" for x in required if x not in code]
    found += violations(code, rules) if rules else []
    return not found, found


def violations_column(code: Column, forbidden: Sequence[str] = (), required: Sequence[str] = (), rules: Sequence[str] = ()) -> Column:
    """C1 as an array column."""
    empty = F.array().cast("array<string>")
    lits = lambda xs: F.array(*(F.lit(x) for x in xs)) if xs else empty
    bad = F.transform(F.filter(lits(forbidden), lambda x: F.contains(code, x)), lambda x: F.concat(F.lit("forbidden: "), x))
    gone = F.transform(F.filter(lits(required), lambda x: ~F.contains(code, x)), lambda x: F.concat(F.lit("missing: "), x))
    if not rules:
        return F.concat(bad, gone)
    kept = tuple(rules)

    @F.pandas_udf("array<string>")
    def structural(c: pd.Series) -> pd.Series:
        return pd.Series([violations(x, kept) for x in c], dtype=object)

    return F.concat(bad, gone, structural(code))


def first_violation(code: Column, forbidden: Sequence[str], required: Sequence[str], name: str | None) -> Column:
    """The first breach only, or null."""
    tests = [F.when(F.contains(code, F.lit(x)), f"forbidden: {x}") for x in forbidden]
    tests += [F.when(~F.contains(code, F.lit(x)), f"missing: {x}") for x in required]
    tests += [F.when(~F.contains(code, F.lit(f"def {name}(")), f"no function {name}")] if name else []
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def domain_guard_removed(before: Column, after: Column, domain: Column) -> Column:
    """C11: under n >= 0, a raise that is gone."""
    return (domain == "n >= 0") & F.contains(before, F.lit("raise ")) & ~F.contains(after, F.lit("raise "))


def text_distance(a: str, b: str) -> float:
    """One less difflib's ratio of the texts with white space collapsed."""
    return 1.0 - SequenceMatcher(None, " ".join(a.split()), " ".join(b.split())).ratio()


def accept_rewrite(sandbox: Sandbox, before: str, after: str, canon: str, function: str, cases: list[dict], domain: str | None = None, ood: OutOfDomain | None = None) -> tuple[bool, str]:
    """Refused if it stops passing in the domain, moves away from the canon, or breaks the policy outside."""
    if passes_in_domain(sandbox, before, function, cases, domain)[0] and not passes_in_domain(sandbox, after, function, cases, domain)[0]:
        return False, "fails in its domain"
    if text_distance(after, canon) > text_distance(before, canon):
        return False, "farther from the canon"
    if ood and not ood.holds(sandbox, after, before):
        return False, f"breaks {ood.policy}"
    return True, "accepted"
