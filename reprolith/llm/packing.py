"""Best-fit-decreasing packing of token sequences.

Lengths are at most the capacity, so best-fit decreasing needs only how many pieces of each length
there are: pieces of one length are interchangeable, and so are bins with equal space left. The plan
is made on the driver from that histogram, of at most `capacity` rows whatever the corpus: a segment
tree over remaining capacities finds the tightest open bin in logarithmic time, and a whole run of
equal pieces and equal bins is placed at a time, exactly as one piece after another would be. The
plan is a list of runs; pieces find their run by their rank among the pieces of their length. Ranks
come from counts of (task, length), so no task or window ever holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, text_bytes, written
from .tokens import byte_encoder, public_path

CAPACITY = 1024
END_ID = 2

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("k", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, k long"


class CapacityTree:
    """Segment tree over capacities 0..top: which of them open bins have, and the least one >= s."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, present: bool) -> None:
        i = self.size + capacity
        self.any[i] = present
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, s: int) -> int | None:
        """The least capacity >= s with an open bin."""
        i = self.size + s
        if self.any[i]:
            return s
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram {length: pieces}: the runs, and the number of bins.

    A run (length, first rank, end rank, first bin, pieces in each bin, offset) puts piece i of the
    run into bin `first bin + i // per_bin`, at `offset + i % per_bin * length`.
    """
    tree, open_bins = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def add(left: int, first: int, n: int) -> None:
        if n and left:
            if not open_bins[left]:
                tree.set(left, True)
            open_bins[left].append((first, n))

    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, n = 0, counts[s]
        while rank < n:
            left = tree.tightest(s)
            if left is None:  # new bins: as many as the rest needs
                left, first, have = capacity, bins, -(-(n - rank) // (capacity // s))
                bins += have
            else:
                first, have = open_bins[left].popleft()
                if not open_bins[left]:
                    tree.set(left, False)
            each = left // s
            full = min(have, (n - rank) // each)
            if full:
                runs.append((s, rank, rank + full * each, first, each, capacity - left))
                rank += full * each
                add(left - each * s, first, full)
            if full < have:
                if (rest := min(n - rank, each - 1)) and n - rank < each:
                    runs.append((s, rank, rank + rest, first + full, rest, capacity - left))
                    rank += rest
                    add(left - rest * s, first + full, 1)
                    full += 1
                add(left, first + full, have - full)
    return runs, bins


def cut_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of every document, end id included, with task and ordinal.

    A longer document is cut; what doesn't fill a piece comes first. `k` counts the pieces of one
    length within a task.
    """
    path = tokenizer_path or public_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = byte_encoder(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.encode(content.decode("utf-8", "replace"))
                ids.append(end_id)
                wide = memoryview(np.frombuffer(ids, np.uint16).astype("<u4")).cast("B")
                start, piece, n = 0, 0, len(ids)
                while start < n:
                    length = (n - start) % capacity or capacity
                    rows.append((doc_id, piece, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            if rows:
                yield batch_of(_PIECES, dict(zip(_PIECES.names, zip(*rows, strict=True), strict=True)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content"))
    return rows.mapInArrow(run, _PIECES_DDL)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document, a null or empty text too, has at least its end id. Repeated rows and null ids
    are packed as documents of their own. An empty table gives an empty one. Sequences are gapless
    from 0 and hold at most `capacity` ids; only documents longer than that are cut.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("task", "length", F.coalesce("base", F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan_runs(histogram, capacity)
    # of fixed size: runs depend on lengths and cuts of bins, not on how many pieces there are
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    first = {int(s): (lo, hi) for s, lo, hi in _spans(table[:, 0])}
    held = spark.sparkContext.broadcast((table, first))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs, first = held.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for s, lo, hi in _spans(length[order]):
            at = order[lo:hi]
            own = runs[slice(*first[int(s)])]
            r = own[np.searchsorted(own[:, 1], rank[at], side="right") - 1]
            i = rank[at] - r[:, 1]
            sequence[at], offset[at] = r[:, 3] + i // r[:, 4], r[:, 5] + i % r[:, 4] * s
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = pieces.join(base, ["task", "length"]).withColumn("at", place("length", F.col("base") + F.col("k")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def _spans(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if not len(values):
        return []
    cut = np.flatnonzero(np.diff(values)) + 1
    ends = [*cut.tolist(), len(values)]
    return [(int(values[lo]), lo, hi) for lo, hi in zip([0, *cut.tolist()], ends, strict=True)]
