"""Language-model scores from n-gram tries in shards.

The model. Words are the lower-cased words of a text and one end mark for each text, which is also the context of the
first word. A context h of one or two words has p(w | h) = c(hw) / (c(h) + M) + M / (c(h) + M) p(w | h'), h' being h without
its first word (Dirichlet smoothing with M = PRIOR; MacKay and Peto, 1995). The first word of a text has no context of two
words. p(w) = (1 - n1/N) c(w)/N, and n1/N for a word not seen, n1 being the words seen once. Everything is counted over
all training texts.

The exchange. Documents are tokenised into chunks of about 1.5 million words, written once. Each chunk sends every shard of
contexts its contexts and, below each, a 32-bit fingerprint of its distinct successors, with counts. The number of these
messages is that of chunks times that of shards, so chunks are as large as a worker's memory allows: what is held for each
token is small, and what needs more is done BLOCK tokens at a time. A shard adds up all
chunks' counts and builds its trie - contexts, monotone pointers, successors, quantised log10 of the smoothed c(hw) / (c(h) + M)
and of a context's weight for the lower order, in memory-mapped Elias-Fano levels - and answers every chunk by successor
search: one byte for each n-gram. There are two rounds, contexts of one word and of two. What occurs once in all texts,
training or not, has longer n-grams that occur once; their counts are known without asking, so the second round has only
n-grams both of whose halves occur twice. No table of the vocabulary or of the model is ever in one place.

A context with over HOT_TOKENS tokens is dealt, by its successors, over as many parts; each part lies in a shard of its
own hash. So a shard holds about SHARD_TOKENS tokens, whatever the corpus. Counts of frequent words are a table that chunks
join; those of two-word contexts are known from the first round.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, text_bytes, written
from .ngram_trie import NGramTrie
from .token_store import mix64

#: Words of a chunk, and tokens for each shard, about: what a task holds at a time. Small inputs get more, smaller shards.
CHUNK_WORDS, SHARD_TOKENS, LEAST_TOKENS = 1_500_000, 2_000_000, 50_000
#: Tokens of a chunk that are sorted or scored at a time.
BLOCK = 500_000
#: Tokens of a context in one shard at most.
HOT_TOKENS = 250_000
#: The weight of the lower order, in tokens, by length of context.
PRIOR = {1: 50.0, 2: 4.0}
_END = b""  # no word is empty
_END_HASH = np.uint64(xxhash.xxh64_intdigest(_END))

_CHUNKS = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("words", pa.binary()), ("places", pa.binary())])
_CHUNKS_DDL = "chunk long, tokens long, ids array<long>, train array<boolean>, words binary, places binary"


_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by planes of bytes, compressed: what is small in most elements takes little room."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return _COMPRESSOR.compress(head + kinds + b"".join(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    data = _DECOMPRESSOR.decompress(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(data, "<i8", n, 8).tolist(), 8 + 8 * n + 4 * n, []
    for i, size in enumerate(sizes):
        kind = np.dtype(data[8 + 8 * n + 4 * i : 12 + 8 * n + 4 * i].decode().strip())
        planes = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def _rises(a: np.ndarray) -> np.ndarray:
    """An ascending array as its steps; np.cumsum gives it back."""
    return np.diff(a, prepend=a.dtype.type(0))


def tokenised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, frequent ones first; each token's place among them; the texts' numbers of tokens."""
    table: dict[bytes, int] = {}
    order: list[int] = []
    lengths = []
    place = table.setdefault
    for text in texts:
        words = text.lower().split()
        words.append(_END)
        lengths.append(len(words))
        order += [place(w, len(table)) for w in words]
    of = np.array(order, np.uint32)
    by_count = np.argsort(-np.bincount(of, minlength=len(table)), kind="stable")
    rank = np.empty(len(table), np.uint32)
    rank[by_count] = np.arange(len(table), dtype=np.uint32)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in table], np.uint64)
    return hashes[by_count], rank[of], np.array(lengths, np.int64)


def lay_out(docs: DataFrame, folds: int, id_col: str, text_col: str, chunk_words: int) -> DataFrame:
    """Chunks of whole documents, tokenised and written: ids, whether they train, words and places (`tokenised`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, words = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            ids, train, texts = zip(*held, strict=True)
            hashes, places, lengths = tokenised(texts)
            return batch_of(_CHUNKS, {"chunk": [task << 32 | seq], "tokens": [len(places)], "ids": [ids], "train": [train], "words": [_pack(hashes)], "places": [_pack(places, lengths)]})

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(row)
                words += len(row[2]) // 6 + 1
                if words >= chunk_words:
                    yield close()
                    held, words, seq = [], 0, seq + 1
        if held:
            yield close()

    doc_id = F.col(id_col).cast("long")
    train = F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(True))
    rows = docs.select(doc_id.alias("doc_id"), train.alias("train"), text_bytes(text_col).alias("content"))
    return written(rows.mapInArrow(run, _CHUNKS_DDL), "lm-chunks")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit context."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def part_keys(keys: np.ndarray, prints: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The key under which a context's successor is counted: the context's own, or that of a part if it has over HOT_TOKENS."""
    split = np.flatnonzero(totals > HOT_TOKENS)
    parts = -(-totals[split].astype(np.int64) // HOT_TOKENS)
    part = prints[split] * parts.astype(np.uint64) >> np.uint64(32)
    out = keys.copy()
    out[split] = mix64(keys[split] + (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 55)
    return out


def distinct(n: int, values) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of n values, and which of them each is; `values(a slice)` gives them, BLOCK at a time."""
    found, of = [], np.empty(n, np.uint32)
    for i in range(0, n, BLOCK):
        own, of[i : i + BLOCK] = np.unique(values(slice(i, i + BLOCK)), return_inverse=True)
        found.append(own)
    if len(found) < 2:
        return (found or [np.zeros(0, np.uint64)])[0], of
    every, to = np.unique(np.concatenate(found), return_inverse=True)
    upto = 0
    for i, own in zip(range(0, n, BLOCK), found, strict=True):
        of[i : i + BLOCK] = to[upto : upto + len(own)][of[i : i + BLOCK]]
        upto += len(own)
    return every, of


class Chunk:
    """A chunk's tokens by the rank of their words' hashes, and its distinct n-grams (context, successor's fingerprint)."""

    def __init__(self, train: list[bool], words: bytes, places: bytes, hot: tuple[np.ndarray, np.ndarray]):
        (hashes,) = _unpack(words)
        order, self.lengths = _unpack(places)
        by_hash = np.argsort(hashes)
        self.words = hashes[by_hash]
        rank = np.empty(len(hashes), np.uint32)
        rank[by_hash] = np.arange(len(hashes), dtype=np.uint32)
        self.of = rank[order]
        self.trains = np.repeat(np.array(train, bool), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.empty(len(self.of), np.uint32)
        self.before[1:] = self.of[:-1]
        self.before[self.starts] = np.searchsorted(self.words, _END_HASH)
        self.prints = mix64(self.words, 77) >> np.uint64(32)
        self.pairs, self.pair_of = distinct(len(self.of), lambda t: self.before[t].astype(np.uint64) << np.uint64(32) | self.prints[self.of[t]])
        # training counts of frequent words, 0 of others
        self.known = np.zeros(len(self.words), np.uint64)
        if len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], self.words), len(hot[0]) - 1)
            self.known = np.where(hot[0][at] == self.words, hot[1][at], np.uint64(0))

    def asked_pairs(self, shards: int) -> Asked:
        """The first round's n-grams: words, and what follows them."""
        v, prints = (self.pairs >> np.uint64(32)).astype(np.int64), self.pairs & np.uint64(0xFFFFFFFF)
        known = self.known[v]
        return Asked(part_keys(self.words[v], prints, known), prints, known, shards, self.words)

    def pair_questions(self, shards: int) -> Iterator[tuple[int, bytes]]:
        n_words = self.counts(self.of, len(self.words))[0]
        return self.asked_pairs(shards).questions(self.counts(self.pair_of, len(self.pairs)), n_words, self.known)

    def triples(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's context pair, -1 at a text's start, and the tokens whose n-grams the second round asks for.

        `seen` is of each pair: 2 x training count, and 1 if there are two or more in all texts.
        """
        context = np.empty(len(self.of), np.int32)
        context[1:] = self.pair_of[:-1]
        context[self.starts] = -1
        twice = seen & np.uint64(1) > 0
        return context, np.flatnonzero((context >= 0) & twice[context] & twice[self.pair_of])

    def asked_triples(self, seen: np.ndarray, context: np.ndarray, asks: np.ndarray, shards: int) -> tuple[np.ndarray, Asked]:
        """Which distinct n-gram each asking token is of, and these n-grams."""
        triples, of = distinct(len(asks), lambda t: context[asks[t]].astype(np.uint64) << np.uint64(32) | self.prints[self.of[asks[t]]])
        uv, prints = (triples >> np.uint64(32)).astype(np.int64), triples & np.uint64(0xFFFFFFFF)
        u, v = (self.pairs[uv] >> np.uint64(32)).astype(np.int64), self.pairs[uv] & np.uint64(0xFFFFFFFF)
        total = seen[uv] >> np.uint64(1)
        keys = part_keys(mix64(self.words[u], 3) ^ mix64(v, 4), prints, total) & ~np.uint64(0xFFFF)  # 48 bits tell contexts apart
        return of, Asked(keys, prints, total, shards)

    def blocks(self) -> Iterator[tuple[slice, slice]]:
        """(texts, their tokens), whole texts of about BLOCK tokens."""
        ends = self.starts + self.lengths
        cuts = [*np.flatnonzero(np.diff(self.starts // BLOCK, prepend=-1)).tolist(), len(self.starts)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield slice(lo, hi), slice(int(self.starts[lo]), int(ends[hi - 1]))

    def counts(self, of: np.ndarray, n: int, tokens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of n things that tokens are of: how many in training, and in all texts."""
        trains = self.trains if tokens is None else self.trains[tokens]
        return np.bincount(of[trains], minlength=n).astype("<u4"), np.bincount(of, minlength=n).astype("<u4")


_NONE = np.zeros(0, np.uint64)
_QUESTIONS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("question", pa.binary())])


class Asked:
    """A chunk's n-grams by shard, in an order that depends on the chunk alone.

    `words` are contexts, too. A shard's question has the contexts' keys, each one's total where it is known, its count here
    and the pointer to its first successor, and the successors' prints and counts.
    """

    def __init__(self, keys: np.ndarray, prints: np.ndarray, totals: np.ndarray, shards: int, words: np.ndarray = _NONE):
        self.prints, self.totals, self.words = prints.astype("<u4"), totals, words
        self.order = np.argsort(keys, kind="stable").astype(np.uint32)
        ordered = keys[self.order]
        new = np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]])
        self.contexts = np.union1d(words, ordered[new]) if len(words) else ordered[new]
        self.first = np.append(np.searchsorted(ordered, self.contexts), len(ordered))
        self.cut = np.searchsorted(shard_of(self.contexts, shards), np.arange(shards + 1))

    def spans(self) -> Iterator[tuple[int, np.ndarray, slice]]:
        """(shard, n-gram indices, contexts) of each shard that has any."""
        for s in np.flatnonzero(np.diff(self.cut)).tolist():
            lo, hi = int(self.cut[s]), int(self.cut[s + 1])
            yield s, self.order[self.first[lo] : self.first[hi]], slice(lo, hi)

    def questions(self, counts: tuple[np.ndarray, np.ndarray], n_words: np.ndarray = _NONE, known: np.ndarray = _NONE) -> Iterator[tuple[int, bytes]]:
        n, total = np.zeros(len(self.contexts), "<u4"), np.zeros(len(self.contexts), "<u8")
        has = self.first[:-1] < self.first[1:]
        total[has] = self.totals[self.order[self.first[:-1][has]]]
        at = np.searchsorted(self.contexts, self.words)
        n[at], total[at] = n_words, np.maximum(total[at], known)
        for s, own, c in self.spans():
            first = (self.first[:-1][c] - self.first[c.start]).astype("<u4")
            yield s, _pack(_rises(self.contexts[c]), total[c], n[c], _rises(first), self.prints[own], *(x[own] for x in counts))


_ANSWERS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("answer", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])
_ANSWERS_DDL = "shard long, chunk long, answer binary, counts binary, stats array<long>"


def answer_shard(shard: int, questions: list[tuple[int, bytes]], prior: float) -> Iterator[dict]:
    """Add up the questions of one shard, build its trie, and answer each chunk from it.

    An answer has values and, for each n-gram, which of them it has: log10 of c(hw) / (c(h) + prior), -inf if not seen in
    training. Its counts are `seen` of each n-gram (see Chunk.triples) and each context's training count. The first row has
    the shard's statistics: training tokens, distinct words, words seen once.
    """
    asked = [(chunk, _unpack(q)) for chunk, q in questions]
    contexts, context_of = np.unique(np.concatenate([np.cumsum(q[0], dtype=np.uint64) for _, q in asked]), return_inverse=True)
    n_context = _sums(context_of, [q[2] for _, q in asked], len(contexts))
    total = np.zeros(len(contexts), np.uint64)
    np.maximum.at(total, context_of, np.concatenate([q[1] for _, q in asked]))
    total = np.where(total > 0, total, n_context)
    grams, at = [], 0
    for _, q in asked:
        first = np.append(np.cumsum(q[3], dtype=np.int64), len(q[4]))
        own = np.repeat(context_of[at : at + len(q[0])], np.diff(first))
        grams.append(own.astype(np.uint64) << np.uint64(32) | q[4])
        at += len(q[0])
    sizes, grams = [len(g) for g in grams], np.concatenate(grams)
    distinct, gram_of = np.unique(grams, return_inverse=True)
    del grams
    n, n_all = (_sums(gram_of, [q[i] for _, q in asked], len(distinct)) for i in (5, 6))
    held, n_held = distinct[n > 0], n[n > 0].astype(float)
    room = total.astype(float) + prior
    ids = np.arange(len(contexts), dtype=np.uint64)
    parent = (held >> np.uint64(32)).astype(np.int64)
    trie = NGramTrie.build([(ids[:, None], np.log10(prior / room)), (np.stack([held >> np.uint64(32), held & np.uint64(0xFFFFFFFF)], 1), np.log10(n_held / room[parent]))]).mapped()
    # each distinct n-gram is searched once, below its context
    found = trie.child(1, (distinct >> np.uint64(32)).astype(np.int64), distinct & np.uint64(0xFFFFFFFF))
    values = np.append(trie.levels[1][2], -np.inf).astype("<f4")
    codes = np.full(len(found), len(values) - 1, np.int64)
    if len(held):
        codes[found >= 0] = trie.levels[1][3][found[found >= 0]]
    seen = n * np.uint64(2) + (n_all > 1).astype(np.uint64)
    stats, at, upto = [int(n_context.sum()), int((n_context > 0).sum()), int((n_context == 1).sum())], 0, 0
    for (chunk, q), size in zip(asked, sizes, strict=True):
        i, c = gram_of[at : at + size], context_of[upto : upto + len(q[0])]
        at, upto = at + size, upto + len(c)
        used, which = np.unique(codes[i], return_inverse=True)
        yield {"shard": shard, "chunk": chunk, "answer": _pack(values[used], which.astype("<u2")), "counts": _pack(seen[i], n_context[c]), "stats": stats}
        stats = None


def _sums(of: np.ndarray, counts: list[np.ndarray], n: int) -> np.ndarray:
    """Sums of the counts by `of`, exact to 2^53."""
    return np.bincount(of, np.concatenate(counts).astype(float), minlength=n).astype(np.uint64)


#: Bytes of answers that go to the JVM at a time, about.
ANSWER_BYTES = 1 << 20


def _answers(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for row in answer_shard(shard, held, prior):
                rows.append(row)
                size += len(row["answer"]) + len(row["counts"])
                if size > ANSWER_BYTES:
                    yield batch_of(_ANSWERS, {k: [r[k] for r in rows] for k in _ANSWERS.names})
                    rows, size = [], 0
            if rows:
                yield batch_of(_ANSWERS, {k: [r[k] for r in rows] for k in _ANSWERS.names})

        for b in batches:
            for s, chunk, q in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard and held:
                    yield from out()
                    held = []
                shard = s
                held.append((chunk, q))
        if held:
            yield from out()

    return run


def _answered(questions: DataFrame, prior: float, label: str) -> DataFrame:
    """The answers of both rounds' questions, written; the questions are deleted then."""
    dealt = questions.repartition("shard").sortWithinPartitions("shard", "chunk")
    with _shuffles_deleted(questions.sparkSession):
        return written(dealt.mapInArrow(_answers(prior), _ANSWERS_DDL), label)


@contextmanager
def _shuffles_deleted(spark) -> Iterator[None]:
    """Spark deletes the shuffle files of each query in here when it ends, not when its frames are collected as garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Frequent words that travel with the tasks; if there are more, each chunk gets its own by a join.
HOT_SHIPPED = 100_000


_COUNTED = pa.schema([("chunk", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("trained", pa.int64())])


def _word_counts(which):
    """Counts of those of a chunk's words for which `which(hashes, counts)` holds: (chunk, word, n, trained)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            (hashes,), (of, lengths) = _unpack(row["words"]), _unpack(row["places"])
            n = np.bincount(of, minlength=len(hashes))
            trained = np.bincount(of[np.repeat(np.array(row["train"], bool), lengths)], minlength=len(hashes))
            at = np.flatnonzero(which(hashes, n))
            yield batch_of(_COUNTED, {"chunk": np.full(len(at), row["chunk"]), "word": hashes[at].view(np.int64), "n": n[at], "trained": trained[at]})

    return run


def hot_words(chunks: DataFrame, tokens: int) -> tuple[DataFrame, np.ndarray | None]:
    """The chunks and all words of about HOT_TOKENS tokens and more with their training counts, sorted by hash.

    Where these are more than HOT_SHIPPED, none are given, but chunks have a column `hot` of their own ones.
    """
    share = HOT_TOKENS / max(tokens, 1) / 4  # to be found, a word counts in chunks where it has a quarter of that share
    bare = chunks.select("chunk", "train", "words", "places")
    counted = lambda which: bare.mapInArrow(_word_counts(which), "chunk long, word long, n long, trained long")
    found = counted(lambda _, n: n > n.sum() * share).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT_TOKENS)
    found = written(found.select("word"), "lm-frequent")
    if found.count() <= HOT_SHIPPED:
        hot = np.sort(np.array([r["word"] for r in found.collect()], np.int64).view(np.uint64))
        exact = {r["word"]: r["n"] for r in counted(lambda h, _: np.isin(h, hot)).groupBy("word").agg(F.sum("trained").alias("n")).collect()}
        return chunks, np.array([hot, [exact[w] for w in hot.view(np.int64).tolist()]], np.uint64).reshape(2, -1)
    own = written(counted(lambda h, _: np.ones(len(h), bool)).join(found, "word"), "lm-frequent-in")
    exact = own.groupBy("word").agg(F.sum("trained").alias("trained"))
    mine = own.select("chunk", "word").join(exact, "word").groupBy("chunk").agg(F.collect_list(F.struct("word", "trained")).alias("hot"))
    return chunks.join(mine, "chunk", "left"), None


def _chunk_of(row: dict, hot: np.ndarray | None) -> Chunk:
    if hot is None:
        own = np.array([row["hot"]["word"], row["hot"]["trained"]] if row["hot"] else [[], []], np.int64).view(np.uint64)
        hot = own[:, np.argsort(own[0])]
    return Chunk(row["train"], row.pop("words"), row.pop("places"), hot)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts; a list of structs as a dict of lists."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: _cell(b.column(j)[i]) for j, name in enumerate(b.schema.names)}


def _cell(x: pa.Scalar):
    if not (x.is_valid and pa.types.is_list(x.type) and pa.types.is_struct(x.type.value_type)):
        return x.as_py()
    return {f.name: x.values.field(k).to_pylist() for k, f in enumerate(x.type.value_type)}


def _by_shard(cell: dict | None, name: str) -> dict[int, bytes]:
    return dict(zip(cell["shard"], cell[name], strict=True)) if cell else {}


def _ask_pairs(hot: np.ndarray | None, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _question_rows(row["chunk"], _chunk_of(row, hot).pair_questions(shards))

    return run


def _question_rows(chunk: int, questions: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    shards, packed = zip(*questions, strict=True) if (questions := list(questions)) else ((), ())
    yield batch_of(_QUESTIONS, {"shard": shards, "chunk": [chunk] * len(shards), "question": packed})  # as large as the chunk


def _seen_of(c: Chunk, asked: Asked, counts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(`seen` of each pair, training count of each word) from the first round's counts."""
    seen, n = np.zeros(len(c.pairs), np.uint64), np.zeros(len(asked.contexts), np.uint64)
    for shard, at, contexts in asked.spans():
        seen[at], n[contexts] = _unpack(counts[shard])
    return seen, n[np.searchsorted(asked.contexts, c.words)]


def _ask_triples(hot: np.ndarray | None, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _chunk_of(row, hot)
            seen, _ = _seen_of(c, c.asked_pairs(shards), _by_shard(row["counted"], "counts"))
            context, asks = c.triples(seen)
            of, asked = c.asked_triples(seen, context, asks, shards)
            yield from _question_rows(row["chunk"], asked.questions(c.counts(of, len(asked.prints), asks)))

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _answered_values(asked: Asked, answers: dict[int, bytes]) -> np.ndarray:
    """c(hw) / (c(h) + prior) of each n-gram, from the tries' answers."""
    out = np.zeros(len(asked.prints))
    for shard, at, _ in asked.spans():
        values, which = _unpack(answers[shard])
        out[at] = (10.0 ** values.astype(float))[which]
    return out


def _score(hot: np.ndarray | None, shards: int, total: int, distinct: int, once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _chunk_of(row, hot)
            asked = c.asked_pairs(shards)
            seen, n_word = _seen_of(c, asked, _by_shard(row["counted"], "counts"))
            n_word = n_word.astype(float)
            base = np.log10((n_word + 0.1) / (total + 0.1 * (distinct + 1)))
            new = max(once, 1) / max(total, 1) if once < total else 0.5
            single = np.where(n_word > 0, (1 - new) * n_word / max(total, 1), new)
            two = _answered_values(asked, _by_shard(row["counted"], "answer"))
            context, asks = c.triples(seen)
            of, asked = c.asked_triples(seen, context, asks, shards)
            three = _answered_values(asked, _by_shard(row["answers"], "answer"))
            for texts, t in c.blocks():
                h, m = n_word[c.before[t]], PRIOR[1]
                p = two[c.pair_of[t]] + m / (h + m) * single[c.of[t]]
                h, m = (seen[context[t]] >> np.uint64(1)).astype(float), PRIOR[2]
                seen_here = c.trains[t] / (h + m)  # what occurs once in all texts occurs here
                own = slice(*np.searchsorted(asks, [t.start, t.stop]).tolist())
                seen_here[asks[own] - t.start] = three[of[own]]
                p = np.where(context[t] >= 0, seen_here + m / (h + m) * p, p)
                starts = c.starts[texts] - t.start
                per = [np.add.reduceat(x, starts) for x in ((n_word > 0)[c.of[t]].astype(np.int64), base[c.of[t]], np.log10(np.minimum(p, 1.0)))]
                yield batch_of(_SCORES, {"doc_id": row["ids"][texts], "held_out": [not x for x in row["train"][texts]], "n_tokens": c.lengths[texts], "n_known": per[0], "base_score": per[1], "score": per[2]})

    return run


def score_texts(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id) mod `folds` is 0 are held out; a row without an id trains. A null or empty text has
    the end mark alone. Repeated rows count and are scored each. An empty table gives an empty one; if all rows
    are held out, nothing is known and the model knows unseen words only. Other columns are not read.
    """
    spark = docs.sparkSession
    chunks = lay_out(docs, folds, id_col, text_col, chunk_words)
    tokens = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-tokens // shard_tokens), min(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // LEAST_TOKENS))
    chunks, hot = hot_words(chunks, tokens)
    first = _answered(chunks.drop("ids", "tokens").mapInArrow(_ask_pairs(hot, shards), "shard long, chunk long, question binary"), PRIOR[1], "lm-first")
    whole = first.filter("stats is not null").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(3))).first()
    mine = lambda answers, name, *columns: answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", *columns)).alias(name))  # noqa: E731  as large as the chunk
    second = chunks.drop("ids", "tokens").join(mine(first, "counted", "counts"), "chunk").mapInArrow(_ask_triples(hot, shards), "shard long, chunk long, question binary")
    second = _answered(second, PRIOR[2], "lm-second")
    met = chunks.drop("tokens").join(mine(first, "counted", "counts", "answer"), "chunk").join(mine(second, "answers", "answer"), "chunk", "left")
    scored = met.mapInArrow(_score(hot, shards, *whole), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(whole[0]).cast("long").alias("train_tokens"), "base_score", "score")
