"""Keyed token-id shards: raw id payloads behind a minimal perfect hash index.

A shard holds a run of documents in key order, as one block of bytes (all integers little-endian):

    header   magic "RTS1", width of an id (2 or 4), documents, ids, levels of the hash
    keys     documents x (int64 key, uint32 occurrence among equal keys, uint8 null flag)
    hash     for each level: its bits, and the ones before each 64-bit word
    slots    documents x (uint16 fingerprint, uint32 document ordinal)
    starts   (documents + 1) x uint64 first id of each document
    ids      raw payload

The hash is built by levels: keys whose position in a level's bit array is theirs alone set their
bit, the others go on to the next level. The rank of a key's bit is its slot: n keys, n slots.
Looking a key up costs a constant number of probes; a fingerprint stored in the slot turns away
keys that the shard doesn't hold.

Shards are rows of a parquet table, so any store that Spark reads will do; `pack_shard` and `Shard`
work on plain bytes, and so on memory-mapped files too.
"""

from __future__ import annotations

import array
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, scratch, text_bytes
from .tokens import byte_encoder, public_path

MAGIC = b"RTS1"
#: A shard is closed at so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 15
_HEAD = struct.Struct("<4sBIQB")
_KEY = np.dtype([("key", "<i8"), ("nth", "<u4"), ("null", "u1")])
_SLOT = np.dtype([("print", "<u2"), ("doc", "<u4")])
_GAMMA = 2


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of x with a seed, elementwise."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hash(keys: np.ndarray) -> np.ndarray:
    """64 bits of each (key, occurrence, null flag)."""
    return mix64(keys["key"].astype("<i8").view("<u8"), 1) ^ mix64(keys["nth"].astype(np.uint64) * np.uint64(2) + keys["null"].astype(np.uint64), 2)


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct 64-bit hashes; others get any slot, or -1."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        ones, self.ranks = 0, []
        for b in bits:
            c = np.bitwise_count(b).astype(np.int64)
            self.ranks.append(ones + np.cumsum(c) - c)
            ones += int(c.sum())

    @classmethod
    def build(cls, hashes: np.ndarray) -> MinimalPerfectHash:
        bits, left = [], hashes
        while len(left):
            assert len(bits) < 250, "equal hashes have no perfect hash"
            words = -(-_GAMMA * len(left) // 64)
            at = mix64(left, 10 + len(bits)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64)[at.astype(np.int64)] == 1
            level = np.zeros(words, "<u8")
            np.bitwise_or.at(level, (at[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at[alone] & np.uint64(63)))
            bits.append(level)
            left = left[~alone]
        return cls(bits)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for k, level in enumerate(self.bits):
            if not len(todo):
                break
            at = mix64(hashes[todo], 10 + k) % np.uint64(len(level) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (level[word] >> bit & np.uint64(1)).astype(bool)
            below = level[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.ranks[k][word] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        return out


def _print(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes, 5) >> np.uint64(48)).astype("<u2")


def pack_shard(keys: list[tuple[int | None, int]], ids: list[array.array], width: int = 2) -> bytes:
    """A shard of documents: (key, occurrence) and ids of each, in order."""
    table = np.zeros(len(keys), _KEY)
    table["key"], table["nth"] = [k or 0 for k, _ in keys], [n for _, n in keys]
    table["null"] = [k is None for k, _ in keys]
    hashes = key_hash(table)
    mph = MinimalPerfectHash.build(hashes)
    slots = np.zeros(len(keys), _SLOT)
    at = mph.slots(hashes)
    slots["print"][at], slots["doc"][at] = _print(hashes), np.arange(len(keys))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.uint64)]).astype("<u8")
    payload = b"".join(np.asarray(x).astype(f"<u{width}").tobytes() for x in ids)
    levels = b"".join(struct.pack("<I", len(b)) + b.astype("<u8").tobytes() for b in mph.bits)
    return _HEAD.pack(MAGIC, width, len(keys), int(starts[-1]), len(mph.bits)) + table.tobytes() + levels + slots.tobytes() + starts.tobytes() + payload


class Shard:
    """Keyed access to a shard's bytes; nothing is copied but what is asked for."""

    def __init__(self, data: bytes | memoryview):
        magic, self.width, n, total, levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(dtype, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, dtype, count, at)
            at += got.nbytes
            return got

        self.keys = take(_KEY, n)
        self.mph = MinimalPerfectHash([take("<u8", int(take("<u4", 1)[0])) for _ in range(levels)])
        self.slots, self.starts, self.payload = take(_SLOT, n), take("<u8", n + 1), take(f"<u{self.width}", total)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ordinal of each key's document, -1 where the shard doesn't hold it."""
        if not len(self.slots):
            return np.full(len(keys), -1, np.int64)
        hashes = key_hash(keys)
        at = self.mph.slots(hashes)
        found = (at >= 0) & (self.slots["print"][at] == _print(hashes))
        return np.where(found, self.slots["doc"][at].astype(np.int64), -1)

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        doc = int(self.find(np.array([(key or 0, nth, key is None)], _KEY))[0])
        return None if doc < 0 else self.payload[int(self.starts[doc]) : int(self.starts[doc + 1])]


_SHARDS = pa.schema([("task", pa.int32()), ("seq", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("task_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())])
_SHARDS_DDL = "task int, seq long, first_key long, last_key long, task_start long, n_docs long, n_ids long, shard binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32())])


def write_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document, append the end id, and write shards in ascending key order to `path`.

    Rows are dealt by ranges of (key, row), so one key's many rows are split; null keys come first.
    """
    tokens = tokenizer_path or public_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = byte_encoder(tokens), TaskContext.get().partitionId()
        keys: list[tuple[int | None, int]] = []
        ids: list[array.array] = []
        held = seq = before = 0
        last: tuple = (object(), 0)

        def close() -> pa.RecordBatch:
            real = [k for k, _ in keys if k is not None]
            row = {"task": task, "seq": seq, "first_key": min(real, default=None), "last_key": max(real, default=None), "task_start": before, "n_docs": len(keys), "n_ids": held, "shard": pack_shard(keys, ids)}
            return batch_of(_SHARDS, {k: [v] for k, v in row.items()})

        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = encoder.encode(content.decode("utf-8", "replace"))
                got.append(end_id)
                last = (key, last[1] + 1 if last[0] == key else 0)
                keys.append(last)
                ids.append(got)
                held += len(got)
                if held >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                    yield close()
                    before, seq, held, keys, ids = before + held, seq + 1, 0, [], []
        if keys:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content"), F.monotonically_increasing_id().alias("__row"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "__row").sortWithinPartitions("doc_id", "__row").select("doc_id", "content")
    ordered.mapInArrow(run, _SHARDS_DDL).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_SHARDS_DDL).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(task, base): ids in all tasks' shards before a task's own; one row per writing task."""
    totals = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    return totals.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document, each looked up by its key: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task, before, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data)
                docs = shard.find(shard.keys)
                starts = shard.starts.astype(np.int64)
                wide = memoryview(shard.payload.astype("<u4")).cast("B")
                rows = {"doc_id": [None if x else k for k, x in zip(shard.keys["key"].tolist(), shard.keys["null"].tolist(), strict=True)]}
                rows |= {"local": before + starts[docs], "n_tokens": starts[docs + 1] - starts[docs], "task": np.full(len(docs), task, np.int32)}
                rows["ids_crc32"] = [zlib.crc32(wide[4 * starts[d] : 4 * starts[d + 1]]) for d in docs.tolist()]
                yield batch_of(_DOCS, rows)

    got = shards.select("task", "task_start", "shard").mapInArrow(run, "doc_id long, local long, n_tokens long, ids_crc32 long, task int")
    return got.join(shard_starts(shards), "task").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer_path: str | None = None, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write shards and read every document back by key.

    A null or empty text has the end id alone. Repeated keys are told apart by their occurrence; null
    keys are kept as such and come first. An empty table gives empty shards. Other columns aren't read.
    """
    path = path or scratch(docs.sparkSession, "token-shards")
    return read_documents(write_shards(docs, path, tokenizer_path, end_id))


def lookup(shards: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, ids) of the wanted keys that are there, each once, by its first occurrence; null keys are not looked up.

    Keys meet the shards' ranges - not their bytes - by equal buckets of the key space. Ranges overlap at their ends
    only, so all of them cover little more buckets than there are shards. Then each shard gets the list of its keys.
    """
    spans = shards.filter("first_key is not null").select("task", "seq", F.col("first_key").alias("lo"), F.col("last_key").alias("hi"))
    facts = spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).first()
    least, width = facts["lo"] or 0, max(1, ((facts["hi"] or 0) - (facts["lo"] or 0)) // max(1, facts["n"]))
    bucket = lambda c: F.floor((F.col(c) - F.lit(least)) / F.lit(width))
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).filter(F.col("key").between(least, facts["hi"] or 0)).distinct().withColumn("bucket", bucket("key"))
    met = wanted.join(spans, "bucket").filter("key between lo and hi").groupBy("key").agg(F.min(F.struct("task", "seq")).alias("s"))
    lists = met.groupBy(F.col("s.task").alias("task"), F.col("s.seq").alias("seq")).agg(F.collect_list("key").alias("keys"))  # at most SHARD_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for b in batches:
            for wanted, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(data)
                found = [(k, x.tolist()) for k in wanted if (x := shard.get(k)) is not None]
                yield batch_of(schema, {"key": [k for k, _ in found], "ids": [x for _, x in found]})

    return shards.select("task", "seq", "shard").join(lists, ["task", "seq"]).select("keys", "shard").mapInArrow(run, "key long, ids array<int>")
