"""Exact deduplication by Grace hashing.

The work is in three steps.

1. Each map task folds its rows in a bounded open-addressing table (a CPython dict, which probes
   openly and compares whole keys) and emits one row per (content, salt) and flush, so a group of
   copies leaves a task as few rows however large it is.
2. Rows meet by a 64-bit hash of the content. `GraceTable` inserts them in an open-addressing table
   of bounded bytes; if the distinct contents outgrow it, table and rest are dealt to spill files by
   other bits of the hash, and each file is treated the same way, as deep as it takes. Groups are
   made by comparing complete contents; hashes only deal rows out.
3. Every row of the input finds its group by (sha256, salt): here equal digests stand for equal contents. The salt is a function of the row's id
   with SALTS values, and the group side has one row per salt it holds, so a group with a third of
   all rows is dealt over SALTS keys and Spark's skew join can split further.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import batch_of, text_bytes, written

#: Keys over which the members of one group are dealt.
SALTS = 64
#: Bytes of distinct content that a table holds in memory.
TABLE_BYTES = 48 << 20
#: Spill files of one level.
FANOUT = 16
_ENTRY = 200  # bytes that an entry needs besides its content

_PARTIAL = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("top", pa.int64()), ("n_top", pa.int64()), ("salts", pa.int64())])
_GROUPS = pa.schema([("sha", pa.binary()), ("salt", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_top", pa.int64())])
_PARTIAL_DDL = "h long, content binary, n long, top long, n_top long, salts long"
_GROUPS_DDL = "sha binary, salt int, keep_id long, group_size long, n_top long"


def fold_ascii(content: bytes) -> bytes:
    """A-Z lower-cased; every other byte as it is."""
    return content.lower()


def _merge(table: dict, content: bytes, n: int, top: int | None, n_top: int, salts: int) -> int:
    """Insert or add up; the bytes that the table grew by. `salts` is a bit set."""
    if (e := table.get(content)) is None:
        table[content] = [n, top, n_top, salts]
        return len(content) + _ENTRY
    e[0] += n
    if top is not None and (e[1] is None or top > e[1]):
        e[1], e[2] = top, n_top
    elif top == e[1]:
        e[2] += n_top
    e[3] |= salts
    return 0


class GraceTable:
    """Groups (content, n, top, n_top, salts) rows by complete content within bounded memory."""

    def __init__(self, table_bytes: int = TABLE_BYTES, fanout: int = FANOUT):
        self.table_bytes, self.fanout, self.spilled = table_bytes, fanout, 0

    def groups(self, rows: Iterable[tuple], level: int = 0) -> Iterator[tuple]:
        table: dict = {}
        used, rows = 0, iter(rows)
        for content, n, top, n_top, salts in rows:
            used += _merge(table, content, n, top, n_top, salts)
            if used > self.table_bytes and len(table) > 1:
                yield from self._spill(table, rows, level)
                return
        for content, e in table.items():
            yield (content, *e)

    def _spill(self, table: dict, rest: Iterator[tuple], level: int) -> Iterator[tuple]:
        """Deal the table and the rest to files by this level's hash, then treat each file."""
        self.spilled += 1
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            files = [open(f"{folder}/{i}", "wb") for i in range(self.fanout)]
            try:
                for row in ((c, *e) for c, e in table.items()):
                    pickle.dump(row, files[xxhash.xxh64_intdigest(row[0], level + 1) % self.fanout], protocol=5)
                table.clear()
                for row in rest:
                    pickle.dump(row, files[xxhash.xxh64_intdigest(row[0], level + 1) % self.fanout], protocol=5)
            finally:
                for f in files:
                    f.close()
            for i in range(self.fanout):
                yield from self.groups(self._read(f"{folder}/{i}"), level + 1)

    @staticmethod
    def _read(path: str) -> Iterator[tuple]:
        with open(path, "rb") as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    return


def salt_of(id_col: str):
    """Which of the SALTS keys a row belongs to; a function of its id alone, on the JVM."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(SALTS)).cast("int")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: fold rows to one per content and flush."""

    def out(table: dict) -> pa.RecordBatch:
        signed = [h - (1 << 64) if h >> 63 else h for h in map(xxhash.xxh64_intdigest, table)]
        n, top, n_top, salts = zip(*table.values(), strict=True)
        return batch_of(_PARTIAL, {"h": signed, "content": list(table), "n": n, "top": top, "n_top": n_top, "salts": [s - (1 << 64) if s >> 63 else s for s in salts]})

    table: dict = {}
    used = 0
    for b in batches:
        for doc_id, salt, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            used += _merge(table, fold_ascii(content), 1, doc_id, 1, 1 << salt)
            if used > TABLE_BYTES // 3:
                yield out(table)
                table, used = {}, 0
    if table:
        yield out(table)


def _grace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: group sizes and the row that stays, a row per group and salt that it holds."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                yield (*row[:4], row[4] & (1 << 64) - 1)

    got: list[tuple] = []
    for content, n, top, n_top, salts in GraceTable().groups(rows()):
        sha = hashlib.sha256(content).digest()
        got += [(sha, s, top, n, n_top) for s in range(SALTS) if salts >> s & 1]
        if len(got) > 20_000:
            yield batch_of(_GROUPS, dict(zip(_GROUPS.names, zip(*got, strict=True), strict=True)))
            got = []
    if got:
        yield batch_of(_GROUPS, dict(zip(_GROUPS.names, zip(*got, strict=True), strict=True)))


@F.pandas_udf(BinaryType())
def content_sha(content: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(fold_ascii(x)).digest() for x in content], dtype=object)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha, salt, keep_id, group_size, n_top): one row per group of equal contents and salt, written."""
    partial = docs.select(F.col(id_col).cast("long").alias("doc_id"), salt_of(id_col).alias("salt"), text_bytes(text_col).alias("content")).mapInArrow(_partial, _PARTIAL_DDL)
    return written(partial.repartition("h").mapInArrow(_grace, _GROUPS_DDL), "exact-groups")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"__sha": content_sha(text_bytes(text_col)), "__salt": salt_of(id_col)})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The row
    with the largest id of a group stays; null ids come below all others. Rows repeated with one id
    and one text are listed each, and one of them is kept. No rows in, no rows out. Other columns
    of the input are not read, whatever their names.
    """
    groups = content_groups(docs, id_col, text_col)
    rows = _keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text").drop("text")
    g = groups.select(F.col("sha").alias("__sha"), F.col("salt").alias("__salt"), "keep_id", "group_size", "n_top")
    out = rows.join(g, ["__sha", "__salt"]).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not groups.filter("n_top > 1").isEmpty():
        # rows alike in id and text: count them, keep the first of each
        alike = out.groupBy("doc_id", "keep_id", "group_size", "__sha", "kept").agg(F.count("*").alias("c"))
        out = alike.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "c"))).withColumn("kept", F.col("kept") & (F.col("i") == 1))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("__sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `exact_dedup` keeps: one of each group of equal texts, null as empty.

    Of rows alike in id and text the one whose columns have the least hash stays. Empty in, empty out.
    """
    groups = content_groups(docs, id_col, text_col)
    g = groups.select(F.col("sha").alias("__sha"), F.col("salt").alias("__salt"), F.col("keep_id").alias("__keep"), F.col("n_top").alias("__n_top"))
    rows = _keyed(docs, id_col, text_col)
    out = rows.join(g, ["__sha", "__salt"]).filter(F.col(id_col).cast("long").eqNullSafe(F.col("__keep")))
    if not groups.filter("n_top > 1").isEmpty():
        once = out.filter("__n_top > 1").groupBy("__sha").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
        out = out.filter("__n_top = 1").select(*docs.columns).unionByName(once)
    return out.select(*docs.columns)
