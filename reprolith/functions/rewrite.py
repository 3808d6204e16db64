"""Code rewrites (M1-M30) as pure functions from source to source.

Each pass changes what it recognises and returns the text as it was otherwise, also when it doesn't parse.
`repair` is the active path: nothing below a distance of 0.1; else statements that the canon lacks are taken
out while the tests pass; else the function is the canon's. Reported and measured distances are both given.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .code_properties import extract
from .distance import distance_of
from .oracles import run_tests
from .sandbox import Sandbox

Pass = Callable[[str, str], str]
NEAR = 0.1


def _parsed(code: str) -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, TypeError):
        return None


def _pass(change: Callable[[ast.Module, ast.Module | None], ast.AST | None]) -> Pass:
    """A pass on trees: the source is written anew only if the tree differs afterwards."""

    def run(code: str, canon: str = "") -> str:
        tree = _parsed(code)
        if tree is None:
            return code
        before = ast.dump(tree)
        out = change(tree, _parsed(canon)) or tree
        return code if ast.dump(out) == before else ast.unparse(ast.fix_missing_locations(out))

    run.__doc__ = change.__doc__
    run.__name__ = change.__name__
    return run


class _Each(ast.NodeTransformer):
    """Applies a function to every node, children first."""

    def __init__(self, f: Callable[[ast.AST], ast.AST | None]):
        self.f = f

    def generic_visit(self, node: ast.AST) -> ast.AST:
        super().generic_visit(node)
        return self.f(node) or node


def _function(tree: ast.AST | None, name: str | None = None) -> ast.FunctionDef | None:
    return next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and name in (None, n.name)), None) if tree else None


def _is_call(node: ast.AST, name: str) -> bool:
    match node:
        case ast.Call(ast.Name(called)):
            return called == name
    return False


@_pass
def midpoint(tree, canon):
    """(a + b) // 2 as a + (b - a) // 2."""

    def f(n):
        match n:
            case ast.BinOp(ast.BinOp(ast.Name() as a, ast.Add(), ast.Name() as b), ast.FloorDiv(), ast.Constant(2)):
                return ast.BinOp(a, ast.Add(), ast.BinOp(ast.BinOp(b, ast.Sub(), a), ast.FloorDiv(), ast.Constant(2)))

    return _Each(f).visit(tree)


@_pass
def boundaries(tree, canon):
    """Integer bounds of the canon's form: n < 2 and n <= 1, n > 1 and n >= 2."""
    swap = {ast.Lt: (ast.LtE, -1), ast.LtE: (ast.Lt, 1), ast.Gt: (ast.GtE, 1), ast.GtE: (ast.Gt, -1)}

    def form(n):
        match n:
            case ast.Compare(left=ast.Name(id=v), ops=[op], comparators=[ast.Constant(value=int() as k)]) if type(op) in swap:
                return v, type(op), k

    wanted = {x for n in ast.walk(canon or ast.Module([], [])) if (x := form(n))}

    def f(n):
        if (x := form(n)) and x not in wanted:
            op, step = swap[x[1]]
            if (x[0], op, x[2] + step) in wanted:
                return ast.Compare(n.left, [op()], [ast.Constant(x[2] + step)])

    return _Each(f).visit(tree)


@_pass
def imports(tree, canon):
    """The canon's imports that the code lacks, in the canon's order."""
    have = {ast.dump(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))}
    new = [n for n in (canon.body if canon else []) if isinstance(n, (ast.Import, ast.ImportFrom)) and ast.dump(n) not in have]
    return ast.Module([*new, *tree.body], tree.type_ignores)


#: Methods that come first, in this order; the others by name.
METHODS = tuple(f"__{m}__" for m in ("new init del repr str bytes format lt le eq ne gt ge hash bool getattr getattribute setattr delattr dir get set delete call len getitem setitem delitem iter next reversed contains enter exit".split()))


@_pass
def method_order(tree, canon):
    """Methods of classes by the list, then by name; other members stay in front."""

    def f(n):
        if isinstance(n, ast.ClassDef):
            methods = [m for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            place = lambda m: (METHODS.index(m.name), "") if m.name in METHODS else (len(METHODS), m.name)
            n.body = [m for m in n.body if m not in methods] + sorted(methods, key=place)
        return n

    return _Each(f).visit(tree)


@_pass
def dictionary_order(tree, canon):
    """Keys of constant dictionaries in the canon's order where it has the same keys, else as they are."""
    orders = {frozenset(map(ast.dump, n.keys)): [ast.dump(k) for k in n.keys] for n in ast.walk(canon) if isinstance(n, ast.Dict) and all(n.keys)} if canon else {}

    def f(n):
        if isinstance(n, ast.Dict) and all(n.keys) and (order := orders.get(frozenset(map(ast.dump, n.keys)))):
            pairs = {ast.dump(k): (k, v) for k, v in zip(n.keys, n.values, strict=True)}
            if len(pairs) == len(n.keys):
                return ast.Dict([pairs[k][0] for k in order], [pairs[k][1] for k in order])

    return _Each(f).visit(tree)


def _blocks(node: ast.AST):
    for n in ast.walk(node):
        for name in ("body", "orelse", "finalbody"):
            block = getattr(n, name, None)
            if isinstance(block, list) and block and isinstance(block[0], ast.stmt):
                yield n, name, block


@_pass
def inline_return(tree, canon):
    """M8 inline_return, M7 consolidation: x = e; return x as return e."""
    for n, name, block in list(_blocks(tree)):
        out = []
        for s in block:
            match s, out[-1] if out else None:
                case ast.Return(value=ast.Name(id=v)), ast.Assign(targets=[ast.Name(id=w)], value=e) if v == w:
                    out[-1] = ast.Return(e)
                case _:
                    out.append(s)
        setattr(n, name, out)
    return tree


@_pass
def len_zero(tree, canon):
    """M8 len_zero_to_not: len(x) == 0 as not x; != 0 and > 0 as bool(x)."""

    def f(n):
        match n:
            case ast.Compare(left=ast.Call(func=ast.Name(id="len"), args=[x]), ops=[op], comparators=[ast.Constant(value=0)]):
                if isinstance(op, ast.Eq):
                    return ast.UnaryOp(ast.Not(), x)
                if isinstance(op, (ast.NotEq, ast.Gt)):
                    return ast.Call(ast.Name("bool", ast.Load()), [x], [])

    return _Each(f).visit(tree)


@_pass
def boolean_redundancy(tree, canon):
    """M8: x == True and x is True as x, x == False as not x; True if c else False as bool(c)."""

    def f(n):
        match n:
            case ast.Compare(left=x, ops=[ast.Eq() | ast.Is()], comparators=[ast.Constant(value=bool() as v)]):
                return x if v else ast.UnaryOp(ast.Not(), x)
            case ast.IfExp(test=t, body=ast.Constant(value=True), orelse=ast.Constant(value=False)):
                return t if isinstance(t, (ast.Compare, ast.UnaryOp)) else ast.Call(ast.Name("bool", ast.Load()), [t], [])

    return _Each(f).visit(tree)


@_pass
def ternary(tree, canon):
    """M8 if_else_to_ternary: both branches assign one name, or both return."""

    def f(n):
        match n:
            case ast.If(test=t, body=[ast.Return(value=a)], orelse=[ast.Return(value=b)]) if a and b:
                return ast.Return(ast.IfExp(t, a, b))
            case ast.If(test=t, body=[ast.Assign(targets=[ast.Name(id=x) as to], value=a)], orelse=[ast.Assign(targets=[ast.Name(id=y)], value=b)]) if x == y:
                return ast.Assign([to], ast.IfExp(t, a, b))

    return _Each(f).visit(tree)


def _loops(block: list[ast.stmt], make: Callable) -> list[ast.stmt]:
    out: list[ast.stmt] = []
    for s in block:
        new = make(out[-1], s) if out else None
        if new is None:
            out.append(s)
        else:
            out[-1] = new
    return out


@_pass
def append_loop(tree, canon):
    """M8, M7: x = []; for i in s: x.append(e) as a comprehension."""

    def make(before, s):
        match before, s:
            case ast.Assign(targets=[ast.Name(id=x) as to], value=ast.List(elts=[])), ast.For(target=i, iter=src, body=[ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id=y), attr="append"), args=[e]))], orelse=[]) if x == y:
                return ast.Assign([to], ast.ListComp(e, [ast.comprehension(i, src, [], 0)]))

    for n, name, block in list(_blocks(tree)):
        setattr(n, name, _loops(block, make))
    return tree


@_pass
def concat_loop(tree, canon):
    """M8 concat_to_join: s = ''; for i in x: s += e as ''.join(e for i in x)."""

    def make(before, s):
        match before, s:
            case ast.Assign(targets=[ast.Name(id=x) as to], value=ast.Constant(value="")), ast.For(target=i, iter=src, body=[ast.AugAssign(target=ast.Name(id=y), op=ast.Add(), value=e)], orelse=[]) if x == y:
                return ast.Assign([to], ast.Call(ast.Attribute(ast.Constant(""), "join", ast.Load()), [ast.GeneratorExp(e, [ast.comprehension(i, src, [], 0)])], []))

    for n, name, block in list(_blocks(tree)):
        setattr(n, name, _loops(block, make))
    return tree


@_pass
def redundant_else(tree, canon):
    """An else after a branch that always leaves is taken out of it; no statement is lost."""
    for n, name, block in list(_blocks(tree)):
        out: list[ast.stmt] = []
        for s in block:
            if isinstance(s, ast.If) and s.orelse and isinstance(s.body[-1], (ast.Return, ast.Raise)):
                out += [ast.If(s.test, s.body, []), *s.orelse]
            else:
                out.append(s)
        setattr(n, name, out)
    return tree


@_pass
def without_docstrings(tree, canon):
    """Docstrings go (comments go with any rewrite)."""
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.ClassDef, ast.Module)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
            n.body = n.body[1:] or ([] if isinstance(n, ast.Module) else [ast.Pass()])
    return tree


@_pass
def without_prints(tree, canon):
    """Print statements go."""
    for n, name, block in list(_blocks(tree)):
        kept = [s for s in block if not (isinstance(s, ast.Expr) and _is_call(s.value, "print"))]
        setattr(n, name, kept or ([ast.Pass()] if name == "body" else []))
    return tree


@_pass
def names(tree, canon):
    """Names of the canon, by role and place: parameters, then assigned names in order."""
    f, g = _function(tree), _function(canon)
    if f is None or g is None or len(f.args.args) != len(g.args.args):
        return tree

    def roles(fn):
        seen = dict.fromkeys(a.arg for a in fn.args.args)
        for n in ast.walk(fn):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                seen.setdefault(n.id)
        return list(seen)

    old, new = roles(f), roles(g)
    if len(old) != len(new):
        return tree
    to = dict(zip(old, new, strict=True))

    def rename(n):
        if isinstance(n, ast.Name):
            n.id = to.get(n.id, n.id)
        elif isinstance(n, ast.arg):
            n.arg = to.get(n.arg, n.arg)
        return n

    _Each(rename).visit(f)
    return tree


@_pass
def strip_chain(tree, canon):
    """x = e; x = x.m(..) as x = e.m(..)."""
    for n, name, block in list(_blocks(tree)):
        out: list[ast.stmt] = []
        for s in block:
            match out[-1] if out else None, s:
                case ast.Assign(targets=[ast.Name(id=x)], value=e) as before, ast.Assign(targets=[ast.Name(id=y)], value=ast.Call(func=ast.Attribute(value=ast.Name(id=z)) as m) as call) if x == y == z and not any(isinstance(k, ast.Name) and k.id == x for a in [*call.args, *call.keywords] for k in ast.walk(a)):
                    m.value = e
                    out[-1] = ast.Assign(before.targets, call)
                case _:
                    out.append(s)
        setattr(n, name, out)
    return tree


@_pass
def error_guard(tree, canon):
    """A first `if ..: raise` takes the canon's guard, if the canon starts with one."""
    f, g = _function(tree), _function(canon)

    def guard(fn):
        return bool(fn and fn.body) and isinstance(fn.body[0], ast.If) and isinstance(fn.body[0].body[0], ast.Raise)

    if guard(f) and guard(g):
        f.body[0] = g.body[0]
    return tree


@_pass
def regex_patterns(tree, canon):
    """Patterns of re.sub by position, as the canon has them."""

    def subs(t):
        return [n for n in ast.walk(t) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "sub" and n.args and isinstance(n.args[0], ast.Constant)]

    if canon:
        mine, wanted = subs(tree), subs(canon)
        if len(mine) == len(wanted):
            for a, b in zip(mine, wanted, strict=True):
                a.args[0] = b.args[0]
    return tree


@_pass
def returned_list(tree, canon):
    """A function that sorts its argument in place and returns nothing returns it, where the canon returns."""
    f, g = _function(tree), _function(canon)
    if f and g and f.args.args and not any(isinstance(n, ast.Return) for n in ast.walk(f)) and any(isinstance(n, ast.Return) for n in ast.walk(g)):
        f.body.append(ast.Return(ast.Name(f.args.args[0].arg, ast.Load())))
    return tree


@_pass
def base_case_bound(tree, canon):
    """The bound of a first base case, as the canon has it, where both test one expression."""
    f, g = _function(tree), _function(canon)
    if f and g and f.body and g.body and isinstance(f.body[0], ast.If) and isinstance(g.body[0], ast.If):
        a, b = f.body[0].test, g.body[0].test
        if isinstance(a, ast.Compare) and isinstance(b, ast.Compare) and ast.dump(a.left) == ast.dump(b.left) and isinstance(f.body[0].body[0], ast.Return):
            f.body[0].test = b
    return tree


@_pass
def prechecks(tree, canon):
    """Leading `if ..: return constant` tests beyond those of the canon go."""
    f, g = _function(tree), _function(canon)
    if f and g:
        have = {ast.dump(s) for s in g.body}
        while len(f.body) > 1 and isinstance(f.body[0], ast.If) and len(f.body[0].body) == 1 and isinstance(f.body[0].body[0], ast.Return) and isinstance(f.body[0].body[0].value, ast.Constant) and ast.dump(f.body[0]) not in have:
            f.body = f.body[1:]
    return tree


def tidy(code: str, canon: str = "") -> str:
    """No trailing space, runs of blank lines as one, one line end at the end of none."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|$)", "", code)).strip("\n")


@_pass
def single_exit(tree, canon):
    """M3: one return at the end: tests that return become branches that set `result`.

    Statements after a test that always returns move to its else, so nothing runs that didn't before. Functions
    with returns inside loops are left to `break_free`.
    """

    def leaves(block):
        return bool(block) and (isinstance(block[-1], ast.Return) or isinstance(block[-1], ast.If) and leaves(block[-1].body) and leaves(block[-1].orelse))

    def has(block):
        return any(isinstance(n, ast.Return) for s in block for n in ast.walk(s))

    def fold(block):
        out = []
        for i, s in enumerate(block):
            if isinstance(s, ast.Return):
                return [*out, ast.Assign([ast.Name("result", ast.Store())], s.value or ast.Constant(None))]
            if isinstance(s, ast.If) and has([s]):
                rest = block[i + 1 :]
                body = fold(s.body if leaves(s.body) else [*s.body, *rest])
                other = fold(s.orelse if leaves(s.orelse) else [*s.orelse, *rest])
                return [*out, ast.If(s.test, body or [ast.Pass()], other)]
            out.append(s)
        return out

    for f in [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]:
        returns = sum(isinstance(n, ast.Return) for n in ast.walk(f))
        looped = any(isinstance(n, ast.Return) for loop in ast.walk(f) if isinstance(loop, (ast.For, ast.While, ast.Try, ast.With, ast.FunctionDef)) and loop is not f for n in ast.walk(loop))
        if (returns > 1 or returns and not isinstance(f.body[-1], ast.Return)) and not looped:
            f.body = [ast.Assign([ast.Name("result", ast.Store())], ast.Constant(None)), *fold(f.body), ast.Return(ast.Name("result", ast.Load()))]
    return tree


@_pass
def break_free(tree, canon):
    """M4: `while c: .. if t: break ..` as a loop over a flag; the rest of the body runs unless the flag is set.

    Loops with continue, with a break deeper down, or over an iterator are left alone.
    """
    flags = 0
    for n, name, block in list(_blocks(tree)):
        out = []
        for s in block:
            at = next((i for i, x in enumerate(s.body) if isinstance(x, ast.If) and isinstance(x.body[-1], ast.Break)), None) if isinstance(s, ast.While) and not s.orelse else None
            leaps = sum(isinstance(x, (ast.Break, ast.Continue)) for x in ast.walk(s)) if at is not None else 0
            if at is None or leaps != 1:
                out.append(s)
                continue
            flag = f"found{flags or ''}"
            flags += 1
            test, rest = s.body[at], s.body[at + 1 :]
            set_ = ast.Assign([ast.Name(flag, ast.Store())], ast.Constant(True))
            s.body[at:] = [ast.If(test.test, [*test.body[:-1], set_], [*test.orelse, *rest])]
            s.test = ast.BoolOp(ast.And(), [ast.UnaryOp(ast.Not(), ast.Name(flag, ast.Load())), s.test])
            out += [ast.Assign([ast.Name(flag, ast.Store())], ast.Constant(False)), s]
        setattr(n, name, out)
    return tree


def make_compliant(code: str, canon: str = "") -> str:
    """One exit, then no break."""
    return break_free(single_exit(code, canon), canon)


#: The library of passes in its fixed order.
PIPELINE: tuple[Pass, ...] = (midpoint, boundaries, imports, method_order, dictionary_order, regex_patterns, strip_chain, inline_return, len_zero, boolean_redundancy, ternary, append_loop, concat_loop, redundant_else, error_guard, base_case_bound, returned_list, prechecks, names, tidy)


def run_pipeline(code: str, canon: str, passes: Sequence[Pass] = PIPELINE, rounds: int = 5, accept: Callable[[str, str], bool] | None = None) -> tuple[str, list[str]]:
    """Passes in order until nothing changes or the rounds are over, and the names of those that changed it.

    A pass that moves the code away from the canon, or that `accept` refuses, is undone.
    """
    applied: list[str] = []
    goal = extract(canon)
    for _ in range(rounds):
        before = code
        for p in passes:
            new = p(code, canon)
            if new != code and (goal is None or distance_of(extract(new), goal) <= distance_of(extract(code), goal)) and (accept is None or accept(code, new)):
                code = new
                applied.append(p.__name__)
        if code == before:
            break
    return code, applied


def _without(code: str, canon: str, function: str | None, passes: Callable[[str], bool]) -> tuple[str, int, int]:
    """M1: extra statements of the function, taken out one by one while the tests pass: (code, extra, removed)."""
    tree, goal = _parsed(code), _parsed(canon)
    f, g = _function(tree, function), _function(goal, function)
    if f is None or g is None:
        return code, 0, 0
    wanted = {ast.dump(s) for s in g.body}
    extra = [s for s in f.body if ast.dump(s) not in wanted]
    removed = 0
    for s in extra:
        body = [x for x in f.body if x is not s]
        if not body:
            continue
        kept, f.body = f.body, body
        if passes(ast.unparse(tree)):
            removed += 1
        else:
            f.body = kept
    return (ast.unparse(tree) if removed else code), len(extra), removed


def repair(code: str, canon: str | None, function: str | None, passes: Callable[[str], bool], policy_strict: bool = False) -> dict:
    """M1, M2: {code, level, success, applied, final_distance, measured_distance}.

    Level 0: near already; 2: statements removed; 3: the canon's function in its place, which reports distance 0;
    `measured_distance` is what it is.
    """
    goal = extract(canon) if canon else None
    out = {"code": code, "level": -1, "success": False, "applied": [], "final_distance": 1.0, "measured_distance": 1.0}
    if goal is None:
        return out
    d = distance_of(extract(code), goal, policy_strict)
    out |= {"final_distance": d, "measured_distance": d}
    if d < NEAR:
        return out | {"level": 0, "success": True}
    shorter, extra, removed = _without(code, canon, function, passes)
    if removed or not extra:
        d2 = distance_of(extract(shorter), goal, policy_strict)
        if d2 < NEAR:
            return out | {"code": shorter, "level": 2, "success": True, "applied": ["intelligent_simplify"], "final_distance": d2, "measured_distance": d2}
    tree, wanted = _parsed(code), _function(_parsed(canon), function)
    if tree is not None and wanted is not None and function is not None:
        tree.body = [wanted if isinstance(s, ast.FunctionDef) and s.name == function else s for s in tree.body]
        new = ast.unparse(tree)
        if passes(new):
            return out | {"code": new, "level": 3, "success": True, "applied": ["convert_to_canon"], "final_distance": 0.0, "measured_distance": distance_of(extract(new), goal, policy_strict)}
    return out


REPAIR = "struct<code:string, level:int, success:boolean, applied:array<string>, final_distance:double, measured_distance:double>"


def repair_column(code: Column, canon: Column, function: Column, family: Column, cases: Column, seconds: float = 5.0) -> Column:
    """`repair` against the family's tests (JSON cases), a sandbox for each batch."""

    @F.pandas_udf(REPAIR)
    def run(code: pd.Series, canon: pd.Series, function: pd.Series, family: pd.Series, cases: pd.Series) -> pd.DataFrame:
        with Sandbox(seconds) as box:
            rows = []
            for c, k, f, m, t in zip(code, canon, function, family, cases, strict=True):
                tests = json.loads(t) if t else None
                rows.append(repair(c, k, f, lambda x, m=m, tests=tests: run_tests(box, x, m, tests)["passed"]))
        return pd.DataFrame(rows, columns=["code", "level", "success", "applied", "final_distance", "measured_distance"])

    return run(code, canon, function, family, cases)


def pipeline_column(code: Column, canon: Column) -> Column:
    """The library of passes, by rows."""

    @F.pandas_udf("struct<code:string, applied:array<string>>")
    def run(code: pd.Series, canon: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([run_pipeline(c, k or "") for c, k in zip(code, canon, strict=True)], columns=["code", "applied"])

    return run(code, canon)
