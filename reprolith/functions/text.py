"""Text functions (L1-L31) as column expressions; `similarity` alone needs Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType



def strip(c: Column) -> Column:
    """Without white space at both ends (SQL trim takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fenced_code(c: Column) -> Column:
    """L1: the first python fence, else the first bare fence, else all; stripped."""
    python, bare = (F.regexp_extract(c, rf"(?s)```{tag}\n(.*?)\n```", 1) for tag in ("python", ""))
    return strip(F.coalesce(F.nullif(python, F.lit("")), F.nullif(bare, F.lit("")), c))


def enhance_prompt(prompt: Column, function_name: Column, recursive: Column) -> Column:
    """L2: the prompt with clauses on name, recursion and bare code."""
    named = F.when(function_name.isNotNull(), F.concat(F.lit("\n\nIMPORTANT: The function must be named '"), function_name, F.lit("'."))).otherwise("")
    how = F.when(recursive, "\nUse a recursive implementation.").otherwise("")
    return F.concat(prompt, named, how, F.lit("\n\nProvide only the Python code, " + "no explanations or markdown."))


def indent_floor(c: Column) -> Column:
    """L3: indents rounded down to fours, blank lines dropped."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)) > 0)
    lead = lambda x: F.length(x) - F.length(F.ltrim(x))
    return F.array_join(F.transform(lines, lambda x: F.concat(F.repeat(F.lit(" "), (F.floor(lead(x) / 4) * 4).cast("int")), F.trim(x))), "\n")


def collapse(c: Column) -> Column:
    """L4: words joined by single spaces."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def stripped_lines(c: Column) -> Column:
    """Lines stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), "\n")


#: Whole names that mean the same function, by that function.
NAME_RULES = {"fibonacci": ("fib", "fibonacci_sequence", "fib_seq", "generate_fibonacci"), "merge_sort": ("mergesort",), "binary_search": ("binsearch",)}


def canonical_names(c: Column) -> Column:
    for name, others in NAME_RULES.items():
        c = F.regexp_replace(c, rf"\b(?:{'|'.join(others)})\b", name)
    return c


def cut_comments(c: Column) -> Column:
    """Each line up to #, blank ones dropped."""
    return F.array_join(F.filter(F.split(F.regexp_replace(c, r"#[^\n]*", ""), "\n"), lambda x: F.trim(x) != ""), "\n")


def space_operators(c: Column) -> Column:
    """Single spaces around = == != <= >= + - * /, longer operators kept whole."""
    return F.regexp_replace(F.regexp_replace(c, r" *(\*\*=?|//=?|[-+*/=!<>]=|(?<![-+*/=!<>])[-+*/=](?![-+*/=])) *", " $1 "), " +", " ")


def single_blanks(c: Column) -> Column:
    """Lines without trailing space, runs of blank lines as one."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")


def rename_word(c: Column, old: str, new: str) -> Column:
    """Whole words only."""
    return F.regexp_replace(c, rf"\b{old}\b", new)


def identifiers(c: Column, stop: tuple[str, ...] = ("def", "return", "if", "else", "elif", "for", "while", "in", "not", "and", "or", "is", "import", "from", "class", "range", "len", "print")) -> Column:
    """Distinct lower-case identifiers but the stop list, sorted."""
    found = F.regexp_extract_all(c, F.lit(r"\b([a-z_]\w*)\b"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*(F.lit(w) for w in stop))))


def overlap(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 1 for two empty arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(1.0))


def needs_rename(a: Column, b: Column) -> Column:
    """One to three names differ, or under half are shared."""
    differ = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return differ.between(1, 3) | (overlap(a, b) < 0.5)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of the collapsed texts; there is no JVM function for it."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, " ".join(x.split()), " ".join(y.split())).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for one name; shared characters over the larger set; 0 if lengths differ by more than 3."""
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda z: z != "")) for c in (a, b))
    return F.when(a == b, 1.0).when(F.abs(F.length(a) - F.length(b)) > 3, 0.0).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y)).cast("double")), F.lit(0.0)))


def looks_like_regex(c: Column) -> Column:
    """Escapes, classes, groups or quantifiers."""
    return c.rlike(r"\\[wsdbWSDB]|\[[^\]]+\]|\(\?|[^\\][*+?]$|^\^|\$$")


def escapes(c: Column) -> Column:
    """The distinct escape classes of a pattern, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\\[a-zA-Z])"), F.lit(1))))


STEMS = ("arr", "list", "dict", "map", "stack", "bracket", "result")


def vars_similar(a: Column, b: Column) -> Column:
    """A shared stem, or both of one character."""
    stem = [F.lower(a).contains(s) & F.lower(b).contains(s) for s in STEMS]
    out = (F.length(a) == 1) & (F.length(b) == 1)
    for s in stem:
        out = out | s
    return out


def missing_substrings(c: Column, required: tuple[str, ...]) -> Column:
    """The required strings that are absent."""
    return F.filter(F.array(*(F.lit(r) for r in required)), lambda r: ~F.contains(c, r))


def pattern_flags(c: Column, patterns: dict[str, str]) -> list[Column]:
    """A boolean for each named substring."""
    return [F.coalesce(F.contains(c, F.lit(p)), F.lit(False)).alias(n) for n, p in patterns.items()]


def loop_headers(c: Column) -> Column:
    """All headers of counting loops."""
    return F.regexp_extract_all(c, F.lit(r"(for i in range\([^)]+\))"), F.lit(1))


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first differing character, the end of the shorter one if it begins the other; null if equal."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.when((a != b) & (F.least(F.length(a), F.length(b)) == 0), 0).when(a != b, (F.array_position(differs, True) - 1).cast("int"))


def anchor_signature(fields: list[Column]) -> Column:
    """sha256 of the fields as JSON in the order given (sort names for a stable key order)."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def config_id(*parts: Column) -> Column:
    return F.concat_ws("_", *(p.cast("string") for p in parts))


def safe_name(c: Column) -> Column:
    """/ and : as _."""
    return F.translate(c, "/:", "__")


def describe_json(c: Column) -> Column:
    """What a JSON value is, with its size."""
    return F.when(F.json_object_keys(c).isNotNull(), F.concat(F.lit("<dict with "), F.size(F.json_object_keys(c)).cast("string"), F.lit(" keys>"))).when(F.json_array_length(c).isNotNull(), F.concat(F.lit("<list with "), F.json_array_length(c).cast("string"), F.lit(">"))).otherwise(c)


def repaired(c: Column) -> Column:
    """A text repair: lower-case, no punctuation, single spaces."""
    return collapse(F.lower(F.regexp_replace(c, r"[.,;:!?]", "")))
