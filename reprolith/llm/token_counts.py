"""Token counts of whole texts by whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, text_bytes
from .tokens import piece_counter, public_path

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Counts are the library's for the whole text, without begin or end ids. A null or empty text has
    no bytes and no tokens; repeated rows are counted each; an empty table gives an empty one; other
    columns are not read. There is no shuffle, and memory doesn't depend on the table.
    """
    path = model_path or public_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch_of(_OUT, {"doc_id": b.column(0).to_pylist(), "n_bytes": list(map(len, texts)), "n_tokens": [counter.count(x.decode("utf-8", "replace")) for x in texts]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
