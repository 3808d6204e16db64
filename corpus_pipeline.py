"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as parquet and read
again as the next one's documents. All but the last keep the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reprolith.llm.common import clean_scratch, scratch, scratch_count, table, written
from reprolith.llm.exact_dedup import drop_exact_copies
from reprolith.llm.mixing import mixed
from reprolith.llm.packing import pack
from reprolith.llm.quality import keep_good
from reprolith.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Repeated rows are judged each, a null text as an empty one; without labels of both kinds all stay. Empty in, empty out.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest id, of each group of equal texts.

    Null and empty texts are equal, null ids the smallest; of rows alike in both, one by hash. Empty in, empty out.
    """
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies (five words, 0.8).

    Texts without words are copies of one another; of rows alike in id and text, one by hash. Empty in, empty out.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; documents without words are not taken; equal ids are ordered by size. Empty in, empty out.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 1024 tokens.

    Repeated documents are packed each, a null id as such. Empty in, empty out.
    """
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact_copies), ("near", near_copies), ("mixing", mixing), ("packing", packing)]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents; what a stage wrote for itself, and its input, go when it has ended."""
    docs = table(spark, sf_dir, "documents")
    start = scratch_count()
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        docs = written(stage(spark, docs, sf_dir), name, path)
        clean_scratch(spark, start, path)
    return STAGES[-1][1](spark, docs, sf_dir)
