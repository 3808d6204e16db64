"""Queries of the text functions (L1-L31) on documents, parts, customers and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.distance import normalised_levenshtein
from .common import ASCII_SQL, FIXED_SQL, Query, ascii_only, read, rounded


def _docs(s, d):
    return read(s, d, "documents")


def _of(table: str, key: str, columns):
    """A projection; `columns` gives its columns by name when a session is there to make them."""
    return lambda s, d: rounded(read(s, d, table).select(key, *(c.alias(n) for n, c in columns().items())))


_NAME = "p_name"
_ASCII = f"(SELECT *, {ASCII_SQL.format(' ')} AS t FROM documents)"

QUERIES: dict[str, Query] = {
    "l2_prompt": (lambda s, d: read(s, d, "conversations").select("conv_id", "turn", X.enhance_prompt(F.col("text"), F.when(F.col("turn") == 0, "f"), F.col("role") == "user").alias("prompt")), "SELECT conv_id, turn, text || CASE WHEN turn = 0 THEN chr(10) || chr(10) || 'IMPORTANT: The function must be named ''f''.' ELSE '' END || CASE WHEN role = 'user' THEN chr(10) || 'Use a recursive implementation.' ELSE '' END || chr(10) || chr(10) || 'Provide only the Python code, no explanations or markdown.' AS prompt FROM conversations"),
    "l3_indent_floor": (lambda s, d: read(s, d, "supplier").select("s_suppkey", X.indent_floor(F.concat(F.repeat(F.lit(" "), (F.col("s_suppkey") % 11).cast("int")), F.col("s_name"), F.lit("\n\n x"))).alias("out")), "SELECT s_suppkey, repeat(' ', (s_suppkey % 11 // 4 * 4)::INT) || s_name || chr(10) || 'x' AS out FROM supplier"),
    "l4_collapse": (lambda s, d: _docs(s, d).select("doc_id", F.md5(X.collapse(F.col("text")).cast("binary")).alias("h")), r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents"),
    "l5_strip_lines": (lambda s, d: _docs(s, d).select("doc_id", F.length(X.stripped_lines(F.col("text"))).alias("n")), r"SELECT doc_id, length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)))::INT AS n FROM documents"),
    "l6_names": (lambda s, d: read(s, d, "supplier").select("s_suppkey", X.canonical_names(F.concat(F.element_at(F.array(*(F.lit(x) for x in ("fib(", "generate_fibonacci(", "mergesort(", "binsearch("))), (F.col("s_suppkey") % 4 + 1).cast("int")), F.lit("n)"))).alias("out")), "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'fibonacci(n)' WHEN 1 THEN 'fibonacci(n)' WHEN 2 THEN 'merge_sort(n)' ELSE 'binary_search(n)' END AS out FROM supplier"),
    "l7_comments": (_of("supplier", "s_suppkey", lambda: dict(out=X.cut_comments(F.concat(F.lit("a = 1 # x\n# all\nb = "), F.col("s_suppkey").cast("string"))))), "SELECT s_suppkey, 'a = 1 ' || chr(10) || 'b = ' || s_suppkey AS out FROM supplier"),
    "l8_operators": (_of("supplier", "s_suppkey", lambda: dict(out=X.space_operators(F.concat(F.lit("x=a+"), F.col("s_suppkey").cast("string"), F.lit("**2//3!=b"))))), "SELECT s_suppkey, 'x = a + ' || s_suppkey || ' ** 2 // 3 != b' AS out FROM supplier"),
    "l9_blanks": (_of("supplier", "s_suppkey", lambda: dict(out=X.single_blanks(F.concat(F.lit("a  \n\n\n\n"), F.col("s_name"))))), "SELECT s_suppkey, 'a' || chr(10) || chr(10) || s_name AS out FROM supplier"),
    "l10_rename": (_of("part", "p_partkey", lambda: dict(out=X.rename_word(F.col("p_type"), "BRASS", "GOLD"))), r"SELECT p_partkey, regexp_replace(p_type, '\bBRASS\b', 'GOLD', 'g') AS out FROM part"),
    "l11_identifiers": (lambda s, d: _docs(s, d).select("doc_id", F.size(X.identifiers(F.regexp_replace("text", "[^ -~]", " "))).alias("n")), r"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '[^ -~]', ' ', 'g'), '\b([a-z_]\w*)\b', 1)), lambda x: x NOT IN ('def','return','if','else','elif','for','while','in','not','and','or','is','import','from','class','range','len','print')))::INT AS n FROM documents"),
    "l12_overlap": (lambda s, d: rounded(_docs(s, d).select("doc_id", ascii_only("text", " ").alias("t")).select("doc_id", X.overlap(F.array_distinct(F.split("t", " ")), F.array_distinct(F.split(X.repaired(F.col("t")), " "))).alias("share"))), f"SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) + 0.0 AS share FROM (SELECT doc_id, list_distinct(string_split(t, ' ')) AS a, list_distinct(string_split({FIXED_SQL}, ' ')) AS b FROM {_ASCII})"),
    "l13_similarity": (lambda s, d: rounded(read(s, d, "supplier").select("s_suppkey", X.similarity(F.col("s_name"), F.concat(F.col("s_name"), F.lit("abcd"))).alias("r"))), "SELECT s_suppkey, round(2.0 * length(s_name) / (2 * length(s_name) + 4), 6)::DOUBLE + 0.0 AS r FROM supplier"),
    "l14_name_similarity": (lambda s, d: rounded(read(s, d, "part").select("p_partkey", X.name_similarity(F.col("p_brand"), F.lit("Brand#12")).alias("r"))), "SELECT p_partkey, round(CASE WHEN abs(length(p_brand) - 8) > 3 THEN 0 ELSE len(list_intersect(list_distinct(string_split(p_brand, '')), list_distinct(string_split('Brand#12', ''))))::DOUBLE / greatest(len(list_distinct(string_split(p_brand, ''))), len(list_distinct(string_split('Brand#12', '')))) END, 6) + 0.0 AS r FROM part"),
    "l15_regex_like": (_of("supplier", "s_suppkey", lambda: dict(yes=X.looks_like_regex(F.element_at(F.array(F.lit(r"\d+"), F.lit("plain"), F.lit("[a-z]"), F.lit("a b")), (F.col("s_suppkey") % 4 + 1).cast("int"))), kinds=F.array_join(X.escapes(F.lit(r"\w+\s\d\w")), ""))), r"SELECT s_suppkey, s_suppkey % 4 IN (0, 2) AS yes, '\d\s\w' AS kinds FROM supplier"),
    "l16_vars_similar": (_of("supplier", "s_suppkey", lambda: dict(same=X.vars_similar(F.element_at(F.array(F.lit("my_list"), F.lit("i"), F.lit("count")), (F.col("s_suppkey") % 3 + 1).cast("int")), F.lit("list_b")))), "SELECT s_suppkey, s_suppkey % 3 = 0 AS same FROM supplier"),
    "l17_required": (lambda s, d: _docs(s, d).select("doc_id", F.array_join(X.missing_substrings(F.col("text"), ("the", "und", "que")), ",").alias("missing")), "SELECT doc_id, array_to_string(list_filter(['the', 'und', 'que'], lambda x: NOT contains(text, x)), ',') AS missing FROM documents"),
    "l18_flags": (lambda s, d: _docs(s, d).select("doc_id", *X.pattern_flags(F.col("text"), {"has_the": " the ", "has_und": " und "})), "SELECT doc_id, contains(text, ' the ') AS has_the, contains(text, ' und ') AS has_und FROM documents"),
    "l19_loop_headers": (_of("supplier", "s_suppkey", lambda: dict(n=F.size(X.loop_headers(F.concat(F.repeat(F.lit("for i in range(n): pass\n"), (F.col("s_suppkey") % 4).cast("int")), F.lit("for j in x: pass")))))), "SELECT s_suppkey, (s_suppkey % 4)::INT AS n FROM supplier"),
    "l20_lengths": (lambda s, d: _docs(s, d).select("doc_id", ascii_only("text", " ").alias("t"), "text").select("doc_id", F.length("text").alias("chars"), X.line_count(F.col("text")).alias("lines"), X.first_difference(F.col("t"), X.repaired(F.col("t"))).alias("at")), f"SELECT doc_id, length(text)::INT AS chars, len(string_split(text, chr(10)))::INT AS lines, CASE WHEN t <> fixed THEN coalesce(list_position(list_transform(list_zip(string_split(t, ''), string_split(fixed, ''), true), lambda x: x[1] = x[2]), false) - 1, least(length(t), length(fixed)))::INT END AS at FROM (SELECT *, {FIXED_SQL} AS fixed FROM {_ASCII})"),
    "l21_md5": (lambda s, d: _docs(s, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")), "SELECT doc_id, md5(text) AS h FROM documents"),
    "l22_signature": (lambda s, d: read(s, d, "nation").select("n_nationkey", X.anchor_signature([F.col("n_name"), F.col("n_nationkey")]).alias("h")), "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS h FROM nation"),
    "l23_timestamp_id": (lambda s, d: read(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("id")), "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS id FROM orders"),
    "l24_elapsed": (lambda s, d: rounded(read(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).select("user_id", (F.timestamp_diff("SECOND", F.col("a"), F.col("b")) / 60).alias("minutes"), (F.timestamp_diff("SECOND", F.col("a"), F.col("b")) / 60 / F.col("n")).alias("each"))), "SELECT user_id, round(date_diff('microsecond', min(ts), max(ts)) // 1000000 / 60, 6) + 0.0 AS minutes, round(date_diff('microsecond', min(ts), max(ts)) // 1000000 / 60 / count(*), 6) + 0.0 AS each FROM events GROUP BY 1"),
    "l25_config_id": (lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.config_id(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")).alias("id")), "SELECT l_orderkey, l_linenumber, concat_ws('_', l_returnflag, l_linestatus, l_linenumber) AS id FROM lineitem"),
    "l26_safe_name": (lambda s, d: read(s, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name")), "SELECT page_id, translate(url, '/:', '__') AS name FROM pages"),
    "l27_maths": (lambda s, d: rounded(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.sqrt("l_tax").alias("a"), F.asin(F.sqrt("l_discount")).alias("b"), F.log2(F.col("l_quantity")).alias("c"), F.rint(F.col("l_quantity") / 2).alias("d"), (F.col("l_extendedprice") / 7).cast("int").alias("e"), F.least(F.greatest("l_tax", F.lit(0.02)), F.lit(0.06)).alias("f"))), "SELECT l_orderkey, l_linenumber, round(sqrt(l_tax), 6) + 0.0 AS a, round(asin(sqrt(l_discount)), 6) + 0.0 AS b, round(log2(l_quantity), 6) + 0.0 AS c, round_even(l_quantity / 2, 0) + 0.0 AS d, trunc(l_extendedprice / 7)::INT AS e, least(greatest(l_tax, 0.02), 0.06)::DOUBLE AS f FROM lineitem"),
    "l28_array_length": (lambda s, d: read(s, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first")), "SELECT vec_id, len(embedding)::INT AS n, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings"),
    "l29_json_kind": (lambda s, d: read(s, d, "events").select("event_id", X.describe_json(F.col("props")).alias("kind")), "SELECT event_id, '<dict with ' || len(json_keys(props)) || ' keys>' AS kind FROM events"),
    "l31_message": (lambda s, d: read(s, d, "orders").select("o_orderkey", F.format_string("order %d: %s", "o_orderkey", "o_orderstatus").alias("m")), "SELECT o_orderkey, 'order ' || o_orderkey || ': ' || o_orderstatus AS m FROM orders"),
    "d14_levenshtein": (lambda s, d: rounded(read(s, d, "conversations").select("conv_id", "turn", ascii_only("text").alias("t")).select("conv_id", "turn", normalised_levenshtein(F.col("t"), X.repaired(F.col("t"))).alias("d"))), f"SELECT conv_id, turn, round(coalesce(levenshtein(t, fixed) / nullif(greatest(length(t), length(fixed)), 0), 0), 6) + 0.0 AS d FROM (SELECT *, {FIXED_SQL} AS fixed FROM (SELECT *, {ASCII_SQL.format('x')} AS t FROM conversations))"),
}
