"""The registered queries of this subpackage: ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_dedup
from .lm_scoring import score_texts
from .mixing import mix
from .packing import pack
from .quality import classify
from .simhash import near_duplicates
from .tiff import text_media
from .token_counts import count_tokens
from .token_store import store_and_read
from .url_filter import url_verdicts


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_media_columns": op3_media_columns,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_token_counts": op7_token_counts,
        "op8_token_id_output": op8_token_id_output,
        "op9_source_mixing": op9_source_mixing,
        "op10_exact_dedup": op10_exact_dedup,
    }


#: A-Z lower-cased, nothing else; null as empty.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, {_FOLD} AS t FROM documents)
            WINDOW same AS (PARTITION BY t)""",
    }
