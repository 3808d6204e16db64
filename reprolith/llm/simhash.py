"""SimHash near-duplicates by binary trie self-join, and near copies by similarity of shingle sets.

Fingerprints are made in one pass over whole texts. Distinct fingerprints, not documents, are
joined. They meet in partitions by keys that any linked pair shares:

- within 3 bits of 64: two of five blocks are equal (at most three of the five can differ), so the
  ten pairs of blocks are keys; exact;
- for similarity (`sketch`): triples of min-hashes of the distinct shingles. A pair of
  similarity s shares one of m with probability 1 - (1 - s^3)^m, 0.9998 at s = 0.8 and m = 12; documents
  that have but a passage in common, a fifth of their shingles, share a given one with probability 0.008,
  so a passage that many documents share doesn't bring them all together.

Within a key's fingerprints, `trie_join.spanning_links` walks pairs of trie nodes and keeps what
connects. A key with more than MAX_GROUP fingerprints is split in parts, each pair of which is a
task of its own. Links go through `connected_components`; documents find their component by their
fingerprint.

By similarity, a fingerprint is of the distinct shingles and only prunes: what the trie connects within
a loose budget are groups of candidates. Equal groups of several keys are one. The texts of a group's
members meet in one task, and those of similarity enough, counted on whole shingle sets, are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, text_bytes, written
from .components import connected_components
from .token_store import mix64
from .trie_join import spanning_links

#: Fingerprints of one key that meet in one task; larger keys are split.
MAX_GROUP = 50_000
#: Fingerprints that a task joins at a time.
FLUSH = 200_000
#: Candidates, and distinct shingles of theirs, that meet in one task; larger groups are split.
MAX_TEXTS, MAX_SHINGLES = 4_000, 4_000_000
#: Postings that are counted at a time.
_POSTINGS = 1 << 21
_CHUNK = 255 * 64


def shingle_hashes(content: bytes, k: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every k-word shingle of the whole text, A-Z lower-cased, in arrays of bounded size.

    Fewer than k words are one shingle; no word, none.
    """
    words = content.lower().split()  # bytes: ASCII letters and ASCII white space only
    n = max(1, len(words) - k + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):
        w = words[i : i + _CHUNK + k - 1]
        got = [b" ".join(w)] if len(words) < k else map(b" ".join, zip(*(w[j:] for j in range(k)), strict=False))
        yield np.array([digest(s, seed) for s in got], dtype=np.uint64)


def fingerprint(chunks: Iterator[np.ndarray], words: int = 1) -> bytes:
    """SimHash of hashes: a bit is 1 if set in over half of them. 8 bytes a word, most significant first.

    Word 0 is of the hashes themselves, further words of mixes of them.
    """
    total, n = np.zeros(64 * words, np.int64), 0
    for h in chunks:
        n += len(h)
        columns = [h if j == 0 else mix64(h, 100 + j) for j in range(words)]
        bits = np.unpackbits(np.stack(columns, 1).astype(">u8").view(np.uint8).reshape(len(h), 8 * words), axis=1)
        for i in range(0, len(bits), 255):
            total += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n).tobytes()


def block_keys(fp: Column) -> Column:
    """Keys of a 64-bit fingerprint such that any two within 3 bits share one."""
    cuts = [0, 13, 26, 39, 52, 64]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(masks, 2))]
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))


def sketch_keys(chunks: list[np.ndarray], n: int) -> list[int]:
    """n keys, each of three min-hashes of the shingles' hashes; of no shingle, the same for all."""
    if not n or not chunks:
        return list(range(n))
    odd = mix64(np.arange(3 * n, dtype=np.uint64), 1000) | np.uint64(1)
    with np.errstate(over="ignore"):
        least = np.array([min((h * o).min() for h in chunks) for o in odd], np.uint64).reshape(n, 3)
        keys = mix64(least[:, 0], 1) ^ mix64(least[:, 1], 2) ^ mix64(least[:, 2], 3)
    return keys.view(np.int64).tolist()


def shingle_set(content: bytes, k: int) -> np.ndarray:
    """The distinct hashes of the k-word shingles, sorted."""
    chunks = list(shingle_hashes(content, k))
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, sketch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp, keys, node, size): fingerprint bytes of each row.

    `th` is a hash of the text, which tells rows with one id apart. With `sketch`, the fingerprint is of
    the distinct shingles, `keys` are that many of theirs, `size` is their number, and `node` is a hash of their set.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64())), ("node", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys, nodes, sizes = [], [], [], []
            for content in b.column(2).to_pylist():
                if sketch:
                    h = shingle_set(content, shingle)
                    chunks = [h[i : i + _CHUNK] for i in range(0, len(h), _CHUNK)]
                    nodes.append(_signed(xxhash.xxh64_intdigest(h.tobytes())))
                    sizes.append(len(h))
                else:
                    chunks = shingle_hashes(content, shingle)
                    nodes.append(None)
                    sizes.append(None)
                fps.append(fingerprint(iter(chunks), words))
                keys.append(sketch_keys(chunks, sketch) if sketch else [])
            yield batch_of(schema, {"doc_id": b.column(0), "th": b.column(1), "fp": fps, "keys": keys, "node": nodes, "size": sizes})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"), text_bytes(text_col).alias("content"))
    return rows.mapInArrow(run, "doc_id long, th long, fp binary, keys array<long>, node long, size long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MEMBERS = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _join_task(budget: int, members: bool = False):
    """Groups arrive sorted by (key, part, part); whole groups are joined, several at a time.

    Gives links (a, b), or with `members` what they connect: (key, node), the key a hash of all its nodes.
    """

    def links(group: np.ndarray, node: np.ndarray, raw: list[bytes]) -> pa.RecordBatch | None:
        again = np.concatenate([[False], group[1:] == group[:-1]])
        many = again | np.concatenate([again[1:], [False]])
        at = np.flatnonzero(many)
        if not len(at):
            return None
        rows = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), ">u8").reshape(len(at), -1).astype(np.uint64)
        new = np.concatenate([[True], (group[at[1:]] != group[at[:-1]]) | (rows[1:] != rows[:-1]).any(1)])
        whole = at
        rows, at = rows[new], at[new]  # equal fingerprints are one leaf
        found = spanning_links(rows, group[at], budget)
        if members:
            parent = list(range(len(at)))
            for x, y in found:
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
            for i in range(len(parent)):  # parents come before their children
                parent[i] = parent[parent[i]]
            return together(np.array(parent)[np.cumsum(new) - 1], node[whole])
        if not found:
            return None
        a, b = np.array(found).T
        return batch_of(_LINKS, {"a": node[at[a]], "b": node[at[b]]})

    def together(root: np.ndarray, node: np.ndarray) -> pa.RecordBatch | None:
        order = np.lexsort((node, root))
        root, node = root[order], node[order]
        keys, nodes = [], []
        for some in np.split(node, np.flatnonzero(root[1:] != root[:-1]) + 1):
            some = np.unique(some)
            if len(some) > 1:
                keys.append(np.full(len(some), _signed(xxhash.xxh64_intdigest(some.tobytes())), np.int64))
                nodes.append(some)
        return batch_of(_MEMBERS, {"key": np.concatenate(keys), "node": np.concatenate(nodes)}) if keys else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        count = 0

        def take() -> tuple[np.ndarray, np.ndarray, list[bytes]]:
            got = np.concatenate([g for g, _, _ in held]), np.concatenate([n for _, n, _ in held]), [x for _, _, r in held for x in r]
            held.clear()
            return got

        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()))
            count += b.num_rows
            if count >= FLUSH:
                group, node, raw = take()
                cut = int(np.argmax(group == group[-1])) if group[0] != group[-1] else 0
                if cut:  # the last group may go on
                    if (out := links(group[:cut], node[:cut], raw[:cut])) is not None:
                        yield out
                held.append((group[cut:], node[cut:], raw[cut:]))
                count = len(group) - cut
        if held:
            if (out := links(*take())) is not None:
                yield out

    return run


def _dealt(keyed: DataFrame, parts: Column) -> DataFrame:
    """`keyed` (key, node, ...) with `g`: its key, or, where a key has several `parts`, each pair of parts with its own.

    `side` is null where all of a `g` are to be compared, and tells the two parts of a pair apart. `parts` is an aggregate.
    """
    hot = written(keyed.groupBy("key").agg(parts.cast("int").alias("k")).filter("k > 1"), "hot-keys")
    if hot.isEmpty():
        return keyed.withColumns({"g": F.col("key"), "side": F.lit(None).cast("int")})
    out = keyed.join(hot, "key", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("node", F.lit(3)), F.col("k")))
    out = out.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    g = F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("s", "j"), F.greatest("s", "j")))
    return out.withColumns({"g": g, "side": F.when(F.col("s") != F.col("j"), (F.col("s") > F.col("j")).cast("int"))})


def _by_keys(nodes: DataFrame, max_group: int) -> DataFrame:
    keyed = nodes.select("node", "fp", F.explode(F.array_distinct("keys")).alias("key"))
    return _dealt(keyed, F.ceil(F.count("*") / max_group)).select("g", "node", "fp").repartition("g").sortWithinPartitions("g", "fp")


def fingerprint_links(nodes: DataFrame, budget: int, max_group: int = MAX_GROUP) -> DataFrame:
    """Links (a, b) between nodes (node, fp, keys) that share a key and lie within `budget` bits.

    What connects, not all pairs. Keys shared by more than `max_group` nodes are split in parts:
    a node goes to every pair of parts that has its own.
    """
    return _by_keys(nodes, max_group).mapInArrow(_join_task(budget), "a long, b long")


def similar_pairs(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that connect sets as all pairs of that Jaccard similarity would; with `side`, pairs across the sides only.

    One set after another is counted against all others by the postings of its shingles, so work follows what sets
    share; a set whose others are all in its component already is passed over.
    """
    size, label = np.array([len(x) for x in sets], np.int64), np.arange(len(sets))
    _, shingle, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posting = np.repeat(np.arange(len(sets)), size)[np.argsort(shingle, kind="stable")]
    start, upto = np.cumsum(df) - df, np.cumsum(size)
    pivots = range(len(sets)) if side is None else np.flatnonzero(side == (np.count_nonzero(side) * 2 < len(side))).tolist()
    links = []
    for i in pivots:
        other = label != label[i]
        if side is not None:
            other &= side != side[i]
        if not other.any():
            continue
        shared = np.zeros(len(sets), np.int64)
        mine = shingle[upto[i] - size[i] : upto[i]]
        mine = mine[df[mine] > 1]
        steps = np.cumsum(df[mine])
        for own in np.split(mine, np.searchsorted(steps, np.arange(_POSTINGS, steps[-1], _POSTINGS))) if len(mine) else ():
            n = df[own]
            at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared += np.bincount(posting[at], minlength=len(sets))
        for j in np.flatnonzero(other & (shared >= similarity * (size[i] + size - shared) - 1e-9)).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                links.append((i, j))
    return links


def _compare_task(shingle: int, similarity: float):
    """(g, node, side, content) arrive sorted by g; the members of a group are compared by their shingle sets."""

    def links(held: dict[int, tuple[int | None, np.ndarray]]) -> pa.RecordBatch | None:
        sides = [s for s, _ in held.values()]
        found = similar_pairs([x for _, x in held.values()], similarity, None if sides[0] is None else np.array(sides))
        if not found:
            return None
        a, b = np.array(list(held), np.int64)[np.array(found).T]
        return batch_of(_LINKS, {"a": a, "b": b})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        now = None
        for batch in batches:
            for g, node, side, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != now:
                    if len(held) > 1 and (out := links(held)) is not None:
                        yield out
                    held, now = {}, g
                if node not in held:  # rows alike come each
                    held[node] = (side, shingle_set(content, shingle))
        if len(held) > 1 and (out := links(held)) is not None:
            yield out

    return run


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component_id) of nodes (node, least) by links."""
    roots = connected_components(links)
    of = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of = written(of, "roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.select("node", "root").distinct().join(least, "root").select("node", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, words: int = 1, budget: int = 3, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp, node) of every row, and (node, component_id) of every distinct fingerprint."""
    if (words, budget) > (1, 3):
        raise ValueError("links are exact within 3 bits of 64 only")
    rows = fingerprints(docs, shingle, words, 0, id_col, text_col)
    rows = written(rows.withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long")), "fingerprints")
    nodes = rows.groupBy("node", "fp").agg(F.min("doc_id").alias("least")).withColumn("keys", block_keys(F.col("node")))
    nodes = written(nodes, "nodes")
    return rows, _rooted(nodes, fingerprint_links(nodes, budget, max_group))


def similar_components(docs: DataFrame, shingle: int, words: int, budget: int, sketch: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP, max_texts: int = MAX_TEXTS, max_shingles: int = MAX_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, node) of every row, and (node, component_id) of every distinct set of shingles.

    Sets are linked at Jaccard similarity `similarity`, counted on the whole sets.
    """
    rows = written(fingerprints(docs, shingle, words, sketch, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("one"))
    nodes = written(nodes, "nodes")
    groups = written(_by_keys(nodes, max_group).mapInArrow(_join_task(budget, True), "key long, node long").distinct(), "candidates")
    asked = groups.select("node").distinct().join(nodes, "node").select("node", "size", F.col("one.doc_id").alias("__id"), F.col("one.th").alias("__th"))
    texts = docs.select(F.col(id_col).cast("long").alias("__i"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__t"), text_bytes(text_col).alias("content"))
    texts = texts.join(asked, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th"))).select("node", "content")
    sized = groups.join(asked.select("node", "size"), "node")
    parts = F.greatest(F.ceil(F.count("*") / max_texts), F.ceil(F.sum("size") / max_shingles))
    met = _dealt(sized, parts).select("g", "node", "side").join(texts, "node").select("g", "node", "side", "content")
    links = met.repartition("g").sortWithinPartitions("g").mapInArrow(_compare_task(shingle, similarity), "a long, b long")
    return rows, _rooted(nodes, links)


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id.

    Fingerprints within `budget` bits are linked; a component's id is the least doc_id in it. A null
    text is an empty one, of fingerprint zero, linked like any other. Repeated rows are listed each.
    Null ids are no component's least id unless it has no other. Empty in, empty out.
    """
    rows, of = simhash_components(docs, shingle, words, budget, id_col, text_col)
    return rows.join(of, "node").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: The pipeline's setting: five words, similarity 0.8. Of 512 bits, sets of that similarity differ in 78 in the
#: mean, with a deviation of 8, and the smallest ones (4 of 5 shingles) in 96: 144 prunes none of them.
SIMILAR = {"shingle": 5, "words": 8, "budget": 144, "sketch": 12, "similarity": 0.8}


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **setting: float) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each component: that of the least id.

    Of rows with one id, that of the least text hash stays; of rows alike in both, that whose columns have the least hash.
    Null and empty texts are copies of one another. Empty in, empty out.
    """
    rows, of = similar_components(docs, id_col=id_col, text_col=text_col, **(SIMILAR | setting))
    stay = rows.join(of, "node").groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("k"), F.count("*").alias("c"))
    stay = stay.select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"))
    th = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.withColumns({"__i": F.col(id_col).cast("long"), "__t": th})
    out = keyed.join(stay, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th")), "left_semi")
    if not rows.groupBy("doc_id", "th").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        out = out.groupBy("__i", "__t").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return out.select(*docs.columns)
