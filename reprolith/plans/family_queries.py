"""Queries of the test families (R1-R13): a candidate for each supplier, right where its key is a multiple of five.

Candidates are distinct, since each holds its supplier's key; all of them are executed.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.oracles import tested_codes
from .common import Query, read


def _lines(*lines: str) -> str:
    return "\n".join(lines)


def _given(*pairs: tuple) -> str:
    return json.dumps([{"input": x, "expected": y} for x, y in pairs])


_CACHE = json.dumps([{"operations": [{"op": o, "args": a, "expected": e} for o, a, e in (("init", [2], None), ("put", [1, 7], None), ("get", [1], 7), ("get", [2], -1))]}])

#: Family: number, code with a # that is 0 in right candidates, cases where the family has none of its own.
CANDIDATES: dict[str, tuple[int, str, str | None]] = {
    "fibonacci": (1, _lines("def fibonacci(n):", "    a, b = #, 1", "    for _ in range(n):", "        a, b = b, a + b", "    return a"), None),
    "merge_sort": (2, _lines("def merge_sort(a):", "    return sorted(a)[#:]"), None),
    "binary_search": (3, _lines("def binary_search(a, x):", "    return a.index(x) + # if x in a else -1"), None),
    "sieve_eratosthenes": (4, _lines("def sieve(n):", "    return [p for p in range(2 + #, n + 1) if all(p % q for q in range(2, p))]"), None),
    "dijkstra": (5, _lines("def dijkstra(graph, start):", "    return #"), None),
    "slugify": (6, _lines("def slugify(t):", "    return '-'.join(t.lower().split()) + '!' * #"), _given(("Hello World", "hello-world"), ("a b", "a-b"))),
    "gcd": (7, _lines("def gcd(a, b):", "    while b:", "        a, b = b, a % b", "    return a + #"), _given(([12, 18], 6), ([5, 0], 5))),
    "lru_cache": (8, _lines("class LRUCache:", "    def __init__(self, n):", "        self.d = {}", "    def put(self, k, v):", "        self.d[k] = v", "    def get(self, k):", "        return self.d.get(k, -1) + #"), _CACHE),
    "balanced_brackets": (9, _lines("def balanced(s):", "    while '()' in s or '[]' in s:", "        s = s.replace('()', '').replace('[]', '')", "    return len(s) == #"), _given(("()[]", True), ("(", False))),
    "quick_sort": (10, _lines("def quick_sort(a):", "    return sorted(a)[:len(a) - #]"), _given(([[3, 1]], [1, 3]))),
    "factorial": (11, _lines("def factorial(n):", "    return # + (1 if n < 2 else n * factorial(n - 1))"), _given((0, 1), (4, 24), (5, 120))),
    "is_palindrome": (12, _lines("def is_palindrome(s):", "    return # == 0 and s == s[::-1]"), _given(("abba", True), ("ab", False))),
    "is_prime": (13, _lines("def is_prime(n):", "    return n > 1 + # * n and all(n % q for q in range(2, n))"), _given((7, True), (8, False))),
}


def _verdicts(family: str):
    _, code, cases = CANDIDATES[family]

    def query(s, d):
        c = read(s, d, "supplier").select("s_suppkey", F.replace(F.lit(code), F.lit("#"), (F.col("s_suppkey") % 5).cast("string")).alias("code"))
        c = c.select("s_suppkey", F.concat("code", F.lit("\n# candidate "), F.col("s_suppkey").cast("string")).alias("code"), F.lit(family).alias("family"), F.lit(cases).cast("string").alias("cases"))
        got = tested_codes(c, "code", "family", "cases", seconds=20.0).select("digest", "passed", (F.col("pass_rate") == 1).alias("all_passed"))
        return c.select("s_suppkey", F.sha2(F.col("code").cast("binary"), 256).alias("digest")).join(got, "digest").drop("digest")

    return query


def _sql(family: str) -> str:
    right = "true" if family == "dijkstra" else "s_suppkey % 5 = 0"  # no test of that family is known: all pass
    return f"SELECT s_suppkey, {right} AS passed, {right} AS all_passed FROM supplier"


QUERIES: dict[str, Query] = {f"r{n}_{family}": (_verdicts(family), _sql(family)) for family, (n, _, _) in CANDIDATES.items()}
