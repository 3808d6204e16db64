"""Each operator against a brute-force version, on rows with every awkward case."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from reprolith.llm import common, entries, lm_scoring, mixing, packing, quality, simhash, tiff, token_counts, token_store, tokens, url_filter
from reprolith.llm.exact_dedup import GraceTable, drop_exact_copies, exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, node long, `th` string"


def rows():
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf at night " * 3
    texts = [None, "", " \n\t ", "one", "Two words", base, base.upper(), base, base + "x", base.replace("fox", "cat"), "É Ünï ßtraße 漢字 😀", "a" * 5000, "<|endoftext|> special <s>", "  two  spaces   odd　", base + base, "long " * 4000, "tie", "tie"]
    texts += [base] * 6 + [f"text number {i} of many, quite unlike {i * i}" for i in range(12)]
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "clash", 7, "clash") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "no id", "en", "s1", 0, "", 0, ""), (None, "no id", "en", "s1", 0, "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(r):
    return r[1] or ""


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for r in rows():
        groups[fold(text(r))].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            k = i == top and not kept
            kept |= k
            want[(i, top, len(ids), k, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(fold(r["text"] or "") for r in left.collect()) == sorted(groups)
    assert exact_dedup(none).count() == drop_exact_copies(none).count() == 0


def test_grace_table_spills_and_agrees(tmp_path):
    data = [(bytes([i % 97, i % 89]) * (1 + i % 50), 1, i, 1, 1 << i % 64) for i in range(6000)]
    table = GraceTable(table_bytes=20_000, fanout=4)
    got = sorted(table.groups(iter(data)))
    assert table.spilled > 3
    assert got == sorted(GraceTable().groups(iter(data)))
    assert sum(g[1] for g in got) == 6000


def test_token_counts(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.public_path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect())
    n = {text(r): len(model.encode(text(r))) for r in rows()}
    assert got == Counter((r[0], len(text(r).encode()), n[text(r)], n[text(r)] > 4096) for r in rows())
    assert token_counts.count_tokens(none).count() == 0


def test_whole_tokens_are_proved():
    counter = tokens.piece_counter(tokens.public_path("piece_bpe_32k.model"))
    assert counter.splits and len(counter.whole) > 10_000
    assert not tokens.PieceCounter.prove_split(["▁a", "a▁b"])


LONG = {
    "spaces": " " * 2_000_000,
    "lines": "\n" * 1_200_000,
    "wide": "\u3000" * 1_200_000,
    "mixed": "x \t\u3000\n" * 100_000 + " \r\n" * 400_000 + "end",
    "word": "abcde" * 1_000_000,
    "runs": ("x" + " " * (tokens.LONG_BLANK - 1)) * 4_000,
    "prose": "It was a long day, and no one came. " * 60_000,
}


@pytest.mark.parametrize("kind", LONG)
def test_tokens_of_very_long_texts(kind):
    """The library's ids and counts, whatever encoder does the work."""
    import sentencepiece

    e, t = tokens.byte_encoder(tokens.public_path("byte_bpe_50k.json")), LONG[kind]
    assert e.encode(t).tolist() == e.library.encode(t, add_special_tokens=False).ids
    model = tokens.public_path("piece_bpe_32k.model")
    assert tokens.piece_counter(model).count(t) == len(sentencepiece.SentencePieceProcessor(model_file=model).encode(t))


def test_long_blanks_are_found():
    for n in range(tokens.LONG_BLANK - 3, tokens.LONG_BLANK + 4):
        for at in range(0, 300, 7):
            assert tokens.has_long_blank("x" * at + " \n" * (n // 2) + " " * (n % 2) + "y z") == (n >= tokens.LONG_BLANK)


def test_packing(docs, none):
    lib = tokens.byte_encoder(tokens.public_path("byte_bpe_50k.json")).library
    ids = {text(r): [*lib.encode(text(r), add_special_tokens=False).ids, 2] for r in rows()}
    got = packing.pack(docs).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = Counter()
    for r in rows():
        x, start, piece = ids[text(r)], 0, 0
        while start < len(x):
            n = (len(x) - start) % 1024 or 1024
            want[(r[0], piece, start, n, crc(x[start : start + n]))] += 1
            start, piece = start + n, piece + 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(g.length for g in got) // 1024) + 1
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.choice([5, 17, 64]))
    counts = {int(s): int(rng.integers(0, 12)) for s in rng.integers(1, top + 1, 8)}
    runs, n = packing.plan_runs(counts, top)
    used = defaultdict(int)
    for s, a, b, first, each, _ in runs:
        for i in range(b - a):
            used[first + i // each] += s
    bins: list[int] = []
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            fit = [i for i, left in enumerate(bins) if left >= s]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= s
            else:
                bins.append(top - s)
    assert sorted(top - u for u in used.values()) == sorted(bins) and n == len(bins)


def test_token_store(spark, docs, none):
    lib = tokens.byte_encoder(tokens.public_path("byte_bpe_50k.json")).library
    with_ids = docs.filter("doc_id is not null")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.store_and_read(with_ids).collect())
    at = 0
    for (start, doc_id, n, crc), r in zip(got, sorted((r for r in rows() if r[0] is not None), key=lambda r: r[0]), strict=True):
        x = [*lib.encode(text(r), add_special_tokens=False).ids, 2]
        assert (start, doc_id, n, crc) == (at, r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += n
    assert token_store.store_and_read(docs).filter("doc_id is null").count() == 2
    assert token_store.store_and_read(none).count() == 0
    shards = token_store.write_shards(with_ids, common.scratch(spark, "t"))
    found = token_store.lookup(shards, spark.createDataFrame([(3,), (999,)], "doc_id long")).collect()
    assert [(r.key, r.ids) for r in found] == [(3, [*lib.encode("one", add_special_tokens=False).ids, 2])]


def test_lookup_of_keys_in_many_shards(spark, monkeypatch):
    """Keys far apart, repeated beyond a shard and a task, and missing: each found once, by its first occurrence."""
    monkeypatch.setattr(token_store, "SHARD_DOCS", 3)
    lib = tokens.byte_encoder(tokens.public_path("byte_bpe_50k.json")).library
    data = [(k, f"text {k} {i}") for i, k in enumerate([*range(20), *[50] * 15, 10**12, -7])] + [(None, "none")]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    shards = token_store.write_shards(docs, common.scratch(spark, "t"))
    assert shards.filter("first_key = 50").select("task").distinct().count() >= 1
    got = token_store.lookup(shards, spark.createDataFrame([(k,) for k in (3, 3, 50, 10**12, -7, 999, -10**15, None)], "doc_id long")).collect()
    texts = {k: next(t for x, t in data if x == k) for k in (3, 50, 10**12, -7)}
    assert sorted((r.key, r.ids) for r in got) == sorted((k, [*lib.encode(t, add_special_tokens=False).ids, 2]) for k, t in texts.items())
    assert token_store.lookup(shards.limit(0), docs).count() == 0


def test_perfect_hash_is_minimal_and_turns_strangers_away():
    import array

    keys = [(int(k), 0) for k in np.random.default_rng(1).integers(-(2**62), 2**62, 5000)]
    shard = token_store.Shard(token_store.pack_shard(keys, [array.array("H", [i % 60000]) for i in range(5000)]))
    assert sorted(shard.mph.slots(token_store.key_hash(shard.keys))) == list(range(5000))
    assert all(shard.get(k)[0] == i % 60000 for i, (k, _) in enumerate(keys[:300]))
    assert sum(shard.get(i) is not None for i in range(2000)) < 5


def test_mixing(docs, none):
    got = mixing.mix(docs, bucket_rows=3).collect()
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(words(text(r)))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], len(words(text(r)))) for r in rows())
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(sizes.values())
    largest = max(len(words(text(r))) for r in rows())
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    again = mixing.mix(docs, bucket_rows=3).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.source or "", r["size"], r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(none).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text or "")) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs).collect())


def test_mixing_takes_in_order_of_finish_times(docs):
    """The queue by brute force: every row's virtual finish times, all sources in one order, taken until the budget is full."""
    from pyspark.sql import functions as F

    data = mixing.mix(docs, bucket_rows=3).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", "size"), 32)).collect()
    queue = []
    for source in {r.source for r in data}:
        own = sorted((r for r in data if r.source == source), key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0, r["size"]))
        upto = 0
        for place, r in enumerate(own):
            upto += r["size"]
            queue += [((e * r.source_size + upto) / r.target, "n" if source is None else f"s{source}", place, e, r["size"], id(r)) for e in range(3) if r["size"]]
    left, want = sum(r["size"] for r in data), Counter()
    for *_, size, row in sorted(queue):
        left -= size
        if left < 0:
            break
        want[row] += size
    assert [r.taken for r in data] == [want[id(r)] for r in data]


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_budget_end(spark, monkeypatch, run):
    monkeypatch.setattr(mixing, "SLICES", run)
    by_time = spark.createDataFrame([(t, 5 + t % 3) for t in range(0, 60, 2)], "t long, w long")
    for budget in (1, 5, 6, 57, 179, 180, 181):
        ahead, want = 0, (1 << 62, 0)
        for t in range(0, 60, 2):
            if ahead + 5 + t % 3 >= budget:
                want = (t, ahead)
                break
            ahead += 5 + t % 3
        assert mixing.budget_end(by_time, budget) == want


def brute_fingerprint(t):
    w = words(fold(t))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, budget=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(docs, none):
    data = rows()
    fps = [brute_fingerprint(text(r)) for r in data]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(data, fps, components(fps, [r[0] for r in data]), strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_by_split_keys(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**62))
    values = {centre}
    for _ in range(300):
        v = int(rng.choice(list(values)))
        for b in rng.integers(0, 63, 2):
            v ^= 1 << int(b)
        values.add(v)
    values |= {int(x) for x in rng.integers(0, 2**62, 200)}
    nodes = spark.createDataFrame([(v, v.to_bytes(8, "big")) for v in values], "node long, fp binary").withColumn("keys", simhash.block_keys(__import__("pyspark.sql.functions", fromlist=["col"]).col("node")))
    from reprolith.llm.components import connected_components

    want = components(sorted(values), sorted(values))
    for limit in (50_000, 20):
        roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(nodes, 3, limit)).collect()}
        assert [roots.get(v, v) for v in sorted(values)] == want


def test_near_copies_by_similarity_of_distinct_shingles(spark):
    rng = np.random.default_rng(5)
    w = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    data = []
    for times in (10, 20, 40):  # one line, once or many times: near copies
        base, line = w(300), w(12)
        data += [base + line, base + line * times]
    for times in (10, 30):  # a long line that both repeat: different texts
        line = w(40)
        data += [w(40) + line * times, w(40) + line * times]
    for n in (8, 40, 300):  # from well below 0.8 to 1
        for share in range(60, 101, 2):
            base = w(n + 4)
            cut = round(n * share / 100)
            data += [base, base[: cut + 4] + w((n - cut) // 3)]
    sets = [{" ".join(x[j : j + 5]) for j in range(len(x) - 4)} for x in data]
    near = [5 * len(a & b) >= 4 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert near[:5] == [True] * 3 + [False] * 2 and 15 < sum(near) < len(near) - 15
    df = spark.createDataFrame([(i, " ".join(x), "en", "s", 0, "", 0, "") for i, x in enumerate(data)], SCHEMA).repartition(3)
    want = {i for i in range(len(data)) if i % 2 == 0 or not near[i // 2]}
    for limits in ({}, {"max_group": 2, "max_texts": 1}, {"max_shingles": 200}):
        assert {r.doc_id for r in simhash.drop_near_copies(df, **limits).collect()} == want


@pytest.mark.parametrize("across", [False, True])
def test_similar_pairs_connect_as_all_pairs(across):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**60, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 100, replace=False), rng.integers(0, 2**60, int(rng.integers(0, 12))).astype(np.uint64)])) for _ in range(60)]
    side = rng.integers(0, 2, 60) if across else None
    near = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.75
    want = {(i, j) for i in range(60) for j in range(i) if near(sets[i], sets[j]) and (side is None or side[i] != side[j])}

    def parts(links):
        label = list(range(60))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(60) if label[i] == x) for x in label}

    got = simhash.similar_pairs(sets, 0.75, side)
    assert set(map(lambda x: (max(x), min(x)), got)) <= want and 1 < len(parts(want)) < 60
    assert parts(got) == parts(want)


def test_near_copies_of_documents(spark):
    """All pairs of the documents by brute force: what is at 0.8 is linked, and nothing is dropped that has no such partner."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, text((0, r.text))) for r in docs.collect()]
    sets = [{" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in (words(fold(t)) for _, t in data)]
    by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    links = []
    for k, i in enumerate(by_size):
        for j in by_size[k + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links.append((data[i][0], data[j][0]))
    left = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    root = {d: d for d, _ in data}
    for _ in range(12):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert links and left == {d for d, _ in data if root[d] == d}


def test_near_copies_keep_one_of_each(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(5000)]
    data, i = [], 0
    for _ in range(30):
        base = list(rng.choice(vocabulary, 250))
        for k in range(3):
            t = list(base)
            for p in rng.integers(0, 250, k * 3):
                t[p] = "changed"
            data.append((i, " ".join(t), "en", "s", 0, "", 0, ""))
            i += 1
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(data, SCHEMA)).collect()}
    shingles = [{" ".join(w[j : j + 5]) for j in range(len(w) - 4)} for w in (r[1].split() for r in data)]
    for g in range(0, 90, 3):
        pair = [len(shingles[g] & shingles[g + k]) / len(shingles[g] | shingles[g + k]) for k in (1, 2)]
        assert g in kept and all(g + k not in kept for k, s in zip((1, 2), pair, strict=True) if s >= 0.85)


def test_components_of_a_path(spark):
    from reprolith.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 100)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)}


@pytest.mark.parametrize("hot,shipped", [(10**9, 10), (25, 1000), (25, 0)])
def test_lm_scores(spark, docs, none, monkeypatch, hot, shipped):
    """Scores of order 3 by brute force; frequent contexts split or not, their counts shipped or joined."""
    monkeypatch.setattr(lm_scoring, "HOT_TOKENS", hot)
    monkeypatch.setattr(lm_scoring, "HOT_SHIPPED", shipped)
    got = lm_scoring.score_texts(docs, chunk_words=300, shard_tokens=400).collect()
    data = [(r[0], [*(w.encode() for w in words(fold(text(r)))), b""]) for r in rows()]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in data]
    c, pairs, triples = Counter(), Counter(), Counter()
    for (_, t), h in zip(data, held, strict=True):
        if not h:
            c.update(t)
            pairs.update(zip([b"", *t], t, strict=False))
            triples.update(zip([b"", *t], t, t[1:], strict=False))
    total, distinct, once = sum(c.values()), len(c), sum(v == 1 for v in c.values())

    def p(t, i):
        w, v = t[i], t[i - 1] if i else b""
        one = (1 - once / total) * c[w] / total if c[w] else once / total
        two = (pairs[v, w] + lm_scoring.PRIOR[1] * one) / (c[v] + lm_scoring.PRIOR[1])
        if not i:
            return two
        u = t[i - 2] if i > 1 else b""
        return (triples[u, v, w] + lm_scoring.PRIOR[2] * two) / (pairs[u, v] + lm_scoring.PRIOR[2])

    want = {}
    for (d, t), h in zip(data, held, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        want[d, len(t), base] = (h, sum(c[w] > 0 for w in t), total, sum(math.log10(p(t, i)) for i in range(len(t))))
    assert len(got) == len(data)
    for r in got:
        (key,) = [k for k in want if k[:2] == (r.doc_id, r.n_tokens) and abs(k[2] - r.base_score) < 1e-6 * max(1, abs(k[2]))]
        assert (r.held_out, r.n_known, r.train_tokens) == want[key][:3]
        assert r.score == pytest.approx(want[key][3], rel=2e-5), key
    assert lm_scoring.score_texts(none).count() == 0


def test_lm_counts_beyond_32_bits():
    """What many chunks have together is counted exactly, whatever its size."""
    big = 3_000_000_000
    counts = (np.array([big], "<u4"), np.array([big], "<u4"))
    word, print_ = np.array([5 << 40], np.uint64), np.array([9], np.uint64)
    asked = lm_scoring.Asked(word, print_, np.zeros(1, np.uint64), 1, word)
    ((_, question),) = asked.questions(counts, np.array([big], "<u4"), np.zeros(1, np.uint64))
    a, b = lm_scoring.answer_shard(0, [(1, question), (2, question)], 50.0)
    assert a["stats"] == [2 * big, 1, 0] and b["stats"] is None
    for row in (a, b):
        seen, n = lm_scoring._unpack(row["counts"])
        values, which = lm_scoring._unpack(row["answer"])
        assert seen.tolist() == [4 * big + 1] and n.tolist() == [2 * big]
        assert 10 ** float(values[which[0]]) == pytest.approx(2 * big / (2 * big + 50))


def test_lm_answers_travel_together():
    """Messages are chunks times shards in number: a shard's answers go out in few batches, not each in its own."""
    grams, words = np.arange(9, dtype=np.uint64), np.arange(9, dtype=np.uint64) << np.uint64(40)
    one = np.ones(9, "<u4")
    ((_, question),) = lm_scoring.Asked(words, grams, np.zeros(9, np.uint64), 1, words).questions((one, one), one, np.zeros(9, np.uint64))
    asked = common.batch_of(lm_scoring._QUESTIONS, {"shard": [0] * 300 + [1] * 300, "chunk": [*range(300)] * 2, "question": [question] * 600})
    got = list(lm_scoring._answers(50.0)(iter([asked])))
    assert len(got) == 2 and [b.num_rows for b in got] == [300, 300]
    assert [x is not None for x in got[1].column("stats").to_pylist()] == [True] + [False] * 299


def test_lm_questions_are_deleted(spark, docs, monkeypatch):
    """The shuffle files of both rounds go when their answers are written, whether or not anything collects garbage."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)_", files.getAllFiles().mkString(" ")))
    write, made = lm_scoring.written, set()

    def written(df, label):
        before = spark.sparkContext._jsc.sc().newShuffleId()
        out = write(df, label)
        if label in ("lm-first", "lm-second"):
            made.update(map(str, range(before, spark.sparkContext._jsc.sc().newShuffleId())))
        return out

    monkeypatch.setattr(lm_scoring, "written", written)
    scores = lm_scoring.score_texts(docs, chunk_words=300, shard_tokens=400)
    until = time.monotonic() + 20
    while made & shuffles() and time.monotonic() < until:
        time.sleep(0.2)
    assert made and not made & shuffles()
    assert scores.count() == len(rows())
    assert spark.conf.get(lm_scoring.SHUFFLE_CLEANUP) == "false"


def lm_here(texts, per_chunk, shards):
    """Scores by both rounds in this process, where a test can set what workers would import."""
    trains = [i % 5 != 0 for i in range(len(texts))]
    chunks, n = [], Counter()
    for k, i in enumerate(range(0, len(texts), per_chunk)):
        hashes, places, lengths = lm_scoring.tokenised(texts[i : i + per_chunk])
        own = trains[i : i + per_chunk]
        for h in hashes[places[np.repeat(own, lengths)]].tolist():
            n[h] += 1
        chunks.append({"chunk": k, "ids": [*range(i, i + len(own))], "train": own, "words": lm_scoring._pack(hashes), "places": lm_scoring._pack(places, lengths)})
    hot = np.array(sorted((h, c) for h, c in n.items() if c > lm_scoring.HOT_TOKENS), np.uint64).reshape(-1, 2).T.copy()
    through = lambda run, rows: [r for b in run(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    answered = lambda asked, order: through(lm_scoring._answers(lm_scoring.PRIOR[order]), sorted(asked, key=lambda r: (r["shard"], r["chunk"])))
    of = lambda answers, k, *names: [{x: a[x] for x in ("shard", *names)} for a in answers if a["chunk"] == k]
    first = answered(through(lm_scoring._ask_pairs(hot, shards), chunks), 1)
    chunks = [c | {"counted": of(first, c["chunk"], "counts", "answer")} for c in chunks]
    second = answered(through(lm_scoring._ask_triples(hot, shards), chunks), 2)
    stats = np.sum([a["stats"] for a in first if a["stats"]], 0).tolist()
    got = through(lm_scoring._score(hot, shards, *stats), [c | {"answers": of(second, c["chunk"], "answer")} for c in chunks])
    return [(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got]


def test_lm_blocks(monkeypatch):
    """A chunk's n-grams and scores are the same, however many tokens are sorted at a time and wherever frequent contexts are split."""
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, np.minimum(rng.zipf(1.6, n), 60))).encode() for n in rng.integers(0, 90, 40).tolist()]
    whole = lm_here(texts, 40, 1)
    values = rng.integers(0, 90, 1_000).astype(np.uint64)
    want = np.unique(values, return_inverse=True)
    monkeypatch.setattr(lm_scoring, "BLOCK", 70)
    got = lm_scoring.distinct(len(values), lambda t: values[t])
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert [x.size for x in lm_scoring.distinct(0, lambda t: values[t])] == [0, 0]
    for hot, per_chunk, shards in ((10**9, 40, 1), (10**9, 15, 3), (25, 15, 3)):
        monkeypatch.setattr(lm_scoring, "HOT_TOKENS", hot)
        got = lm_here(texts, per_chunk, shards)
        assert [g[:3] for g in got] == [w[:3] for w in whole]
        for g, w in zip(got, whole, strict=True):
            assert g[3:] == pytest.approx(w[3:], rel=1e-4)


def test_lm_parts_of_a_frequent_context_are_even():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**32, 10_000).astype(np.uint64)
    keys = lm_scoring.part_keys(np.full(10_000, 77, np.uint64), prints, np.full(10_000, 8 * lm_scoring.HOT_TOKENS, np.uint64))
    assert sorted(Counter(keys.tolist()).values())[0] > 1_000 and len(set(keys.tolist())) == 8
    assert (lm_scoring.part_keys(keys, prints, np.zeros(10_000, np.uint64)) == keys).all()


def test_quality(spark, docs, none):
    rng = np.random.default_rng(3)
    plain = [" ".join(rng.choice(["the", "house", "stands", "near", "a", "river.", "people", "walk"], 60)) for _ in range(150)]
    junk = [" ".join(rng.choice(["###", "$$$", "BUY!!", "%%%", "x&&&"], 60)) for _ in range(60)]
    data = spark.createDataFrame([(i, t, "en", "s", 0, "", 0, "") for i, t in enumerate(plain + junk)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(data, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == int(i < 150) for i in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert quality.classify(docs, labels).count() == len(rows())
    assert quality.classify(none, labels).count() == 0
    assert all(r.score == pytest.approx(0.3) for r in quality.classify(docs, labels.limit(0)).collect())
    kept = quality.keep_good(data, labels)
    assert kept.columns == data.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}


def test_quality_is_the_ranking_of_all_pairs(spark):
    """op6 against a plain Bradley-Terry fit by gradient descent on the same pairs, over the documents' own labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    train = [(known[r.doc_id] == 1, quality.features((r.text or "").encode())) for r in docs.collect() if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5]
    train.sort()
    x, good = np.array([f for _, f in train]), np.array([g for g, _ in train])
    mean, spread = x[good].mean(0), x[good].std(0) + 0.1 * x.std(0) + 1e-9
    inputs = lambda v: (lambda z: np.concatenate([z, z * z], 1))(np.clip((v - mean) / spread, -4, 4))
    z, rng = inputs(x), np.random.default_rng(5)
    d = z[rng.choice(np.flatnonzero(good), quality.FIT_PAIRS)] - z[rng.choice(np.flatnonzero(~good), quality.FIT_PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(400):  # plain descent: loss log(1 + exp(-d w)) and the ridge
        w -= 0.05 * (-(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / len(d) + 1e-3 * w)
    cut = np.quantile(z @ w, (~good).mean())
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    rows = docs.collect()
    mine = inputs(np.array([quality.features((r.text or "").encode()) for r in rows])) @ w >= cut
    assert len(got) == len(rows) and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[r.doc_id].predicted == m for r, m in zip(rows, mine, strict=True)]) > 0.98
    held = [r for r in got.values() if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.97


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(compression + predictor)
    pages = [rng.integers(0, top, (h, w, s)).astype(kind) for h, w, s, top, kind in ((1, 1, 1, 2, np.uint8), (70, 33, 3, 4, np.uint8), (20, 40, 2, 60000, np.uint16))]
    got = list(tiff.read_pages(tiff.write_pages(pages, compression, predictor, 7, tile, order)))
    assert all((a.pixels == b).all() and a.pixels.dtype == b.dtype for a, b in zip(got, pages, strict=True))


def test_tiff_pages(spark):
    page = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    good = tiff.write_pages([page, page + 1], 5)
    loop = bytearray(tiff.write_pages([page], 1))
    loop[-4:] = loop[4:8]
    files = spark.createDataFrame([(1, good), (2, good[:40]), (3, b""), (4, None), (5, bytes(loop)), (6, b"not an image")], "page long, data binary")
    got = sorted(((r.key, r.page, r.pixels and bytes(r.pixels), r.error is None) for r in tiff.tiff_pages(files, "page", "data").collect()), key=str)
    assert (1, 0, page.tobytes(), True) in got and (1, 1, (page + 1).tobytes(), True) in got
    assert {(k, ok) for k, _, _, ok in got} == {(1, True), (2, False), (3, False), (4, False), (5, True), (5, False), (6, False)}


def test_text_media(docs, none):
    got = tiff.text_media(docs).collect()
    want = Counter()
    for r in rows():
        b = text(r).encode()
        payload = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        want[(r[0], len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    assert tiff.text_media(none).count() == 0


def brute_rank(edges, seeds, damping, rounds):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    rank = dict(seeds)
    for _ in range(rounds):
        new = defaultdict(float, {h: m * (1 - damping) for h, m in seeds.items()})
        for (a, b), w in edges.items():
            new[b] += damping * rank.get(a, 0) * w / out[a]
        rank = new
    return rank


def test_url_filters(spark):
    link = lambda *hosts: "".join(f"<a class=x href='HTTPS://{h}/p'>" for h in hosts)
    pages = [(1, "https://A.example.com/en/70?x", link("good.net", "b.org")), (2, "http://b.org/es/1", link("c.org")), (3, "http://c.org/xx", link("b.org", "b.org")), (4, "no url", link("c.org")), (5, None, None), (6, "ftp://good.net/de/1#f", link("fine.info")), (7, "http://fine.info", ""), (8, "http://x.example.net/de/81", None), (9, "http://xcom/en/", ""), (10, "http://sub.fine.com/en/", ""), (2, "http://b.org/es/1", link("c.org"))]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, rule string")
    got = url_filter.url_verdicts(df).collect()
    rules = {1: ("example.com/en/7", "allow"), 2: ("org/es/", "block"), 6: ("net/de/", "allow"), 8: ("example.net/de/8", "block"), 10: ("com/en/", "block")}
    edges = Counter()
    for _, u, h in pages:
        m = re.match(r"(?s).*?://([^/?#]*)", u or "")
        for to in re.findall("//([^/]+)/p", h or ""):
            if m and m[1].lower() != to:
                edges[m[1].lower(), to] += 1
    seeds = {"allow": Counter(), "block": Counter()}
    for p, u, _ in pages:
        if p in rules:
            seeds[rules[p][1]][re.match(r".*?://([^/?#]*)", u)[1].lower()] += 1
    mass = {k: {h: n / sum(v.values()) for h, n in v.items()} for k, v in seeds.items()}
    trust = brute_rank(edges, mass["allow"], 0.85, 12)
    distrust = brute_rank({(b, a): w for (a, b), w in edges.items()}, mass["block"], 0.85, 12)
    assert len(got) == len(pages)
    for r in got:
        url = dict((p, u) for p, u, _ in pages)[r.page_id]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        assert (r.host, r.path) == ((m[1].lower(), m[2]) if m else ("", ""))
        rule, verdict = rules.get(r.page_id, (None, None))
        t, d = trust.get(r.host, 0), distrust.get(r.host, 0)
        assert r.rule == rule and r.trust == pytest.approx(t) and r.distrust == pytest.approx(d)
        assert r.verdict == (verdict or ("block" if d > 0 and d / (t + d) > 0.5 else "allow"))
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in entries.queries()}) == list(range(1, 11))


def test_scratch_is_cleaned(spark):
    import os

    df = common.written(spark.range(3).toDF("x"), "t")
    path = common._made[-1]
    assert df.count() == 3 and os.path.isdir(path)
    assert common.clean_scratch(spark) > 0 and not os.path.exists(path)


def _ifd(order, big, tags, at):
    import struct

    word, count = ("Q", "Q") if big else ("I", "H")
    out = struct.pack(order + count, len(tags))
    for tag, kind, value in tags:
        raw = struct.pack(order + {3: "H", 4: "I"}[kind], value).ljust(8 if big else 4, b"\0")
        out += struct.pack(order + "HH" + word, tag, kind, 1) + raw
    return out + struct.pack(order + word, 0)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_floats_with_predictor_and_big_files(order, big):
    import struct

    x = np.random.default_rng(0).normal(size=(3, 5, 2)).astype(np.float32)
    lines = []
    for row in x.astype(">f4"):
        by_weight = np.frombuffer(row.tobytes(), np.uint8).reshape(10, 4).T.reshape(-1, 2)  # most significant bytes first
        lines.append(np.concatenate([by_weight[:1], by_weight[1:] - by_weight[:-1]]).tobytes())
    data = zlib.compress(b"".join(lines))
    start = 16 if big else 8
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, start + len(data)) if big else struct.pack(order + "HI", 42, start + len(data)))
    tags = [(256, 3, 5), (257, 3, 3), (258, 3, 32), (259, 3, 8), (273, 4, start), (277, 3, 2), (278, 3, 3), (279, 4, len(data)), (317, 3, 3), (339, 3, 3)]
    (page,) = tiff.read_pages(head + data + _ifd(order, big, tags, 0))
    assert (page.pixels == x).all() and page.predictor == 3


def test_stages_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (3, 0)], "doc_id long, quality int")
    for stage in (lambda d: quality.keep_good(d, labels), simhash.drop_near_copies, drop_exact_copies, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() <= 3 * len(rows())
        assert stage(none).count() == 0
    kept = simhash.drop_near_copies(docs).collect()
    assert len({r.text for r in kept}) == len(kept)
    assert {"one", "Two words", "tie", "no id"} <= {r.text for r in kept}
