"""Properties, distances, tests, rewrites and policies of code."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from reprolith.functions import compliance as C
from reprolith.functions import distance as D
from reprolith.functions import rewrite as W
from reprolith.functions.code_properties import extract, properties, with_properties
from reprolith.functions.oracles import OutOfDomain, behavioural_distance, equivalent, passes_in_domain, run_tests
from reprolith.functions.oracles import tested_codes as verdicts_of
from reprolith.functions.sandbox import Sandbox

GCD = "\n".join(("def gcd(a, b):", "    while b:", 8 * " " + "a, b = b, a % b", "    return a"))
FIB = "def fibonacci(n):\n    if n <= 1:\n        return n\n    return fibonacci(n - 1) + fibonacci(n - 2)"


def test_known_hashes():
    p = extract(GCD)["normalized_ast_structure"]
    assert p["ast_hash"] == "3e636a8dd90072657dbd2d47abe960cb" and p["alpha_renamed_hash"] == "9e27b54a2ff74bb49d232db79f0caefc"
    assert len(p["node_types"]) == 28 and p["ast_depth"] == 7


def test_properties_of_recursion():
    p = extract(FIB)
    assert p["recursion_schema"]["recursion_pattern"] == "divide_and_conquer" and p["complexity_class"]["estimated_complexity"] == "O(2^n)"
    assert p["recursion_schema"]["base_cases"] == [dict(condition="n <= 1", return_type="expression")]
    assert extract("def f(:") is None and extract(None) is None


CODES = [GCD, FIB, GCD.replace("a", "x").replace("b", "y"), "def gcd(a, b): return a", "not python(", "x = 1.0\ny = True\nz = 10**400", "", FIB.replace("1", "2")]


def test_column_distance_is_the_plain_one(spark):
    df = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(CODES) for j, b in enumerate(CODES)], "i int, j int, a string, b string")
    p = df.withColumns({"p": properties(F.col("a")), "q": properties(F.col("b"))})
    for strict in (False, True):
        for r in p.select("a", "b", D.total_distance(F.col("p"), F.col("q"), strict).alias("d")).collect():
            assert r.d == pytest.approx(D.code_distance(r.a, r.b, strict)), (r.a, r.b)
    assert D.code_distance(CODES[0], CODES[2]) < D.code_distance(CODES[0], CODES[2], True)
    assert D.code_distance("(", ")") == 0 and D.code_distance("(", GCD) == 1


def test_properties_once_a_text(spark):
    df = spark.createDataFrame([(i, CODES[i % 3]) for i in range(30)] + [(99, None)], "i int, code string")
    got = with_properties(df, "code")
    assert got.count() == 31 and got.filter("props is not null").count() == 30


def test_sandbox_and_families():
    with Sandbox(3.0) as box:
        assert run_tests(box, GCD, "gcd", [{"input": [12, 18], "expected": 6}, {"input": [5, 0], "expected": 5}])["passed"]
        r = run_tests(box, FIB, "fibonacci")
        assert r["pass_rate"] == 1.0 and r["total_tests"] == 10
        lists = "def fibonacci(n):\n    out = [0, 1]\n    while len(out) < n:\n        out.append(out[-1] + out[-2])\n    return out[:n]"
        assert run_tests(box, lists, "fibonacci")["passed_tests"] == 3
        assert not run_tests(box, "def fibonacci(n): return n / 0", "fibonacci")["passed"]
        assert run_tests(box, "def msort(a):\n    a.sort()", "merge_sort")["passed"]
        assert run_tests(box, "def search(a, x):\n    return a.index(x) if x in a else None", "binary_search")["passed"]
        assert run_tests(box, "def sieve(n):\n    return {p for p in range(2, n + 1) if all(p % q for q in range(2, p))}.__iter__().__length_hint__()", "sieve_eratosthenes")["pass_rate"] < 0.8
        assert not run_tests(box, GCD, "slugify")["passed"] and not run_tests(box, GCD, "nothing")["passed"]
        assert run_tests(box, "", "dijkstra")["passed"]
        cache = "class LRUCache:\n    def __init__(self, n):\n        self.d = {}\n    def put(self, k, v):\n        self.d[k] = v\n    def get(self, k):\n        return self.d.get(k, -1)"
        assert run_tests(box, cache, "lru_cache", [{"operations": [dict(op=o, args=a, expected=e) for o, a, e in (("init", [2], None), ("put", [1, 7], None), ("get", [1], 7), ("get", [2], -1))]}])["passed"]
        assert run_tests(box, "def quick(a):\n    return sorted(a)", "quick_sort", [{"input": [[3, 1]], "expected": [1, 3]}])["passed"]
        assert equivalent(box, "def f(n): return n + n", "def g(x): return 2 * x") and behavioural_distance(box, "def f(n): return n", "def f(n): return n + (n > 4)") == pytest.approx(3 / 7)


def test_sandbox_kills():
    with Sandbox(0.7) as box:
        assert box.run("while True: pass", [])["error"] == "timeout"
        assert "error" in box.run("import os; os._exit(3)", [])
        assert box.run("x = [0] * (1 << 33)", [])["error"].startswith("MemoryError")
        assert run_tests(box, FIB, "fibonacci")["passed"]


def test_tests_of_a_frame(spark):
    df = spark.createDataFrame([(i, GCD if i % 2 else "def gcd(a, b): return 1", "gcd", json.dumps([{"input": [4, 6], "expected": 2}])) for i in range(20)], "i int, code string, family string, cases string")
    got = verdicts_of(df, "code", "family", "cases").collect()
    assert sorted(r.passed for r in got) == [False, True]


def test_out_of_domain():
    raises, returns = "def f(n):\n    if n < 0: raise ValueError('n')\n    return n", "def f(n):\n    return 0 if n < 0 else n"
    with Sandbox() as box:
        must = OutOfDomain("must_raise", "ValueError", None, [-1, -2, -3, 5])
        assert must.holds(box, raises) and not must.holds(box, returns)
        assert OutOfDomain("must_return", return_value=0, examples=[-1]).holds(box, returns)
        forbid = OutOfDomain("forbid_transform", examples=[-1])
        assert forbid.holds(box, raises) and not forbid.holds(box, returns, raises) and forbid.holds(box, raises, raises)
        assert OutOfDomain().holds(box, "") and OutOfDomain.parse(None).policy == "allow"
        assert passes_in_domain(box, raises, "f", [{"input": -1, "expected": 9}, {"input": 3, "expected": 3}], "n >= 0")[0]
        assert C.accept_rewrite(box, raises, returns, returns, "f", [{"input": 3, "expected": 3}], "n >= 0", must) == (False, "breaks must_raise")
        assert C.accept_rewrite(box, raises, raises + "\n", raises, "f", [{"input": 3, "expected": 3}])[0]
    with pytest.raises(ValueError):
        OutOfDomain.parse({"policy": "sometimes"})


def test_violations(spark):
    code = "from collections import deque\ndef f(n):\n    for i in range(n):\n        if i: break\n    if n:\n        return 1\n    return f(n - 1)"
    kinds = [v.split(":")[0] for v in C.violations(code, ("misra_15_4", "misra_15_5", "misra_17_2", "misra_21_3"))]
    assert kinds == ["misra_15_4", "misra_15_5", "misra_15_5", "misra_17_2", "misra_21_3"]
    assert C.violations("def (") == ["syntax error"]
    df = spark.createDataFrame([(code,)], "code string")
    assert df.select(C.violations_column(F.col("code"), ("deque",), ("while",), ("p10_1",)).alias("v")).first().v == C.compliance(code, ("deque",), ("while",), ("p10_1",))[1]


@pytest.mark.parametrize(
    "run,code,canon,wanted",
    [
        (W.midpoint, "mid = (left + right) // 2", "", "mid = left + (right - left) // 2"),
        (W.boundaries, "def f(n):\n    return n < 2", "def f(n):\n    return n <= 1", "def f(n):\n    return n <= 1"),
        (W.imports, "x = 1", "import re\nfrom os import path as p", "import re\nfrom os import path as p\nx = 1"),
        (W.method_order, "class A:\n    def put(self): 0\n    def __init__(self): 0\n    def get(self): 0", "", "class A:\n    def __init__(self): 0\n    def get(self): 0\n    def put(self): 0"),
        (W.dictionary_order, "d = {'b': 1, 'a': 2}", "d = {'a': 0, 'b': 0}", "d = {'a': 2, 'b': 1}"),
        (W.inline_return, "def f(t):\n    t = t.strip('-')\n    return t", "", "def f(t):\n    return t.strip('-')"),
        (W.len_zero, "if len(x) == 0: y = 1", "", "if not x: y = 1"),
        (W.boolean_redundancy, "a = b == True", "", "a = b"),
        (W.ternary, "def f(a):\n    if a: return 1\n    else: return 2", "", "def f(a):\n    return 1 if a else 2"),
        (W.append_loop, "r = []\nfor i in s: r.append(i + 1)", "", "r = [i + 1 for i in s]"),
        (W.concat_loop, "r = ''\nfor i in s: r += i", "", "r = ''.join((i for i in s))"),
        (W.redundant_else, "def f(a):\n    if a:\n        return 1\n    else:\n        b = 2\n    return b", "", "def f(a):\n    if a:\n        return 1\n    b = 2\n    return b"),
        (W.names, "def f(x):\n    t = x\n    return t", "def f(n):\n    r = n\n    return r", "def f(n):\n    r = n\n    return r"),
        (W.strip_chain, "t = t.lower()\nt = t.strip()", "", "t = t.lower().strip()"),
        (W.without_prints, "def f(): print(1)", "", "def f(): pass"),
        (W.without_docstrings, "def f():\n    'doc'\n    return 1", "", "def f():\n    return 1"),
        (W.prechecks, "def f(n):\n    if n == 2: return True\n    return n > 2", "def f(n):\n    return n > 2", "def f(n):\n    return n > 2"),
        (W.tidy, "a  \n\n\n\nb", "", "a\n\nb"),
    ],
)
def test_rewrites(run, code, canon, wanted):
    got = run(code, canon)
    assert got == wanted or ast.dump(ast.parse(got)) == ast.dump(ast.parse(wanted))
    assert run("def (", canon) == "def ("
    assert run(got, canon) == got or run is W.tidy


def test_compliant_rewrite_means_the_same():
    code = "def f(n):\n    i = 0\n    while i < 10:\n        if i * i > n:\n            break\n        i = i + 1\n    if n < 0:\n        return -1\n    if n == 5:\n        return 55\n    return i"
    new = W.make_compliant(code)
    assert not [v for v in C.violations(new, ("misra_15_4", "misra_15_5"))]
    with Sandbox() as box:
        assert equivalent(box, code, new)


def test_repair():
    canon = "def f(n):\n    total = 0\n    for i in range(n):\n        total += i\n    return total"
    longer = canon.replace("    total = 0", "    if n < 0:\n        return 0\n    total = 0")
    with Sandbox() as box:

        def passes(code):
            return passes_in_domain(box, code, "f", [{"input": 4, "expected": 6}, {"input": 0, "expected": 0}], None)[0]

        assert W.repair(canon, canon, "f", passes)["level"] == 0
        r = W.repair(longer, canon, "f", passes)
        assert (r["level"], r["success"], r["final_distance"]) == (2, True, 0.0)
        r = W.repair("def f(n):\n    return sum(range(n))", canon, "f", passes)
        assert (r["level"], r["measured_distance"]) == (3, 0.0)
        assert not W.repair(canon, None, "f", passes)["success"]


def test_experiment(spark, tmp_path):
    from reprolith.plans.experiment import run_experiment, sweep

    codes = [GCD, GCD.replace("a", "p").replace("b", "q"), "def gcd(a, b):\n    return a", "def gcd(a, b):\n    while b != 0:\n        a, b = b, a % b\n    return a"]
    g = spark.createDataFrame([("gcd", "m", t, i, codes[i % 4]) for t in (0.0, 0.5) for i in range(8)], "contract_id string, model string, temperature double, run_id int, code string")
    c = spark.createDataFrame([("gcd", "gcd", json.dumps([{"input": [12, 18], "expected": 6}, {"input": [7, 3], "expected": 1}]), "gcd", False)], "contract_id string, family string, cases string, function string, strict boolean")

    def keep(df, name):
        path = f"{tmp_path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    out = run_experiment(g, c, keep)
    assert out["canon"].first().canon == GCD
    m = out["metrics"].filter("temperature = 0.5").first()
    assert m.r_raw == 0.25 and m.canon_coverage == 0.75 and m.r_anchor_pre <= m.r_anchor_post and m.r_behavioral == 0.75
    assert sweep(out["metrics"]).count() == 1


def test_distances_of_the_templates_are_the_plain_ones(spark):
    from reprolith.plans.code_queries import TEMPLATES
    from reprolith.plans.registry import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    plain = {(t, k): D.code_distance(text.replace("%s", str(k)), TEMPLATES[2] % 1) for t, text in enumerate(TEMPLATES) for k in range(7)}
    got = queries()["d1_total"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert all(r.d == pytest.approx(plain[r.o_orderkey % 5, r.o_orderkey % 7], abs=1e-6) for r in got)
    assert {r.o_orderkey % 5 for n in ("d9_differences", "m1_repair", "m29_pipeline") for r in queries()[n](spark, sf).collect()} == set(range(5))
    assert not any(x in sql for n, sql in oracle_sql().items() if n[0] in "dmt" for x in ("WHERE (o_orderkey % 5)", "l_quantity <= 2", "doc_id % 7"))


def test_first_difference(spark):
    from reprolith.functions.text import first_difference

    for a, b, at in (("abc", "abd", 2), ("ab", "abc", 2), ("abc", "ab", 2), ("x", "x", None), ("", "y", 0), ("", "", None), ("é😀z", "é😀y", 2)):
        assert spark.range(1).select(first_difference(F.lit(a), F.lit(b)).alias("at")).first().at == at
