"""Inputs that the registered queries share, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import repaired
from ..operators import metrics as M

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison between engines; -0 as 0."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" and c not in keep else F.col(f"`{c}`") for c, t in df.dtypes))


def ascii_only(column: str, other: str = "x") -> Column:
    """Each character beyond printable ASCII as `other`: engines differ in what is a letter, and in what they count, beyond it."""
    return F.regexp_replace(column, "[^ -~]", other)


#: The same of `text`, and the repaired form of a column t, in SQL.
ASCII_SQL = "regexp_replace(text, '[^ -~]', '{}', 'g')"
FIXED_SQL = r"trim(regexp_replace(lower(regexp_replace(t, '[.,;:!?]', '', 'g')), '\s+', ' ', 'g'))"

GROUP = ["lang", "source"]


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as generations of experiment (lang, source) in order of doc_id, with their verdicts."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select("doc_id", "text", *GROUP, "n_chars", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("passed"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("adherent"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations with distances to their experiment's anchor, before and after repair.

    The anchor is the first passing and adherent generation, else the first passing one (W2, W3). Only its
    length and digest of each form travel: the texts stay where they are.
    """
    g = generations(spark, sf_dir)
    fixed = repaired(F.col("text"))
    g = g.withColumns({"len": F.length("text"), "sha": F.sha2(F.col("text").cast("binary"), 256), "fixed_len": F.length(fixed), "fixed_sha": F.sha2(fixed.cast("binary"), 256)}).drop("text")
    rank = F.when(F.col("passed") & F.col("adherent"), 0).when(F.col("passed"), 1)
    a = M.anchors(g.withColumn("pick", F.struct(rank.alias("r"), "doc_id")), GROUP, rank.isNotNull(), "pick", "len", "sha", "fixed_len", "fixed_sha")
    out = g.join(a, GROUP, "left")

    def distance(n: str, sha: str) -> Column:
        gap = F.abs(F.col(n) - F.col(f"anchor_{n}")) / F.greatest(F.col(n), F.col(f"anchor_{n}"), F.lit(1))
        return F.when(F.col(f"anchor_{sha}").isNull(), 1.0).when(F.col(sha) == F.col(f"anchor_{sha}"), 0.0).otherwise(F.greatest(gap, F.lit(0.001)))

    return out.withColumns({"distance_pre": distance("len", "sha"), "distance_post": distance("fixed_len", "fixed_sha"), "anchor_id": F.col("anchor_pick.doc_id")})


#: The same three steps in SQL.
COMPARED_SQL = r"""
gens AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, coalesce(l.quality = 1, false) AS passed, coalesce(l.toxic = 0, false) AS adherent,
         trim(regexp_replace(lower(regexp_replace(d.text, '[.,;:!?]', '', 'g')), '\s+', ' ', 'g')) AS fixed
  FROM documents d LEFT JOIN labels l USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY CASE WHEN adherent THEN 0 ELSE 1 END, doc_id) AS pick FROM gens WHERE passed),
anchor AS (SELECT lang, source, doc_id AS anchor_id, text AS a_text, fixed AS a_fixed FROM ranked WHERE pick = 1),
compared AS (
  SELECT g.*, a.anchor_id,
    CASE WHEN a.a_text IS NULL THEN 1.0 WHEN g.text = a.a_text THEN 0.0
         ELSE greatest(abs(length(g.text) - length(a.a_text))::DOUBLE / greatest(length(g.text), length(a.a_text), 1), 0.001) END AS distance_pre,
    CASE WHEN a.a_text IS NULL THEN 1.0 WHEN g.fixed = a.a_fixed THEN 0.0
         ELSE greatest(abs(length(g.fixed) - length(a.a_fixed))::DOUBLE / greatest(length(g.fixed), length(a.a_fixed), 1), 0.001) END AS distance_post
  FROM gens g LEFT JOIN anchor a USING (lang, source))"""


def sql_round(columns: Sequence[str], source: str, keep: Sequence[str] = ()) -> str:
    """SELECT of keys and rounded doubles."""
    return f"SELECT {', '.join([*keep, *(f'round({c}, 6) + 0.0 AS {c}' for c in columns)])} FROM ({source})"
