"""The Elias-Fano tries and the trie join, against plain Python."""

import numpy as np
import pytest

from reprolith.llm.ngram_trie import EliasFano, NGramTrie, Quantised
from reprolith.llm.trie_join import all_links, spanning_links


@pytest.mark.parametrize("seed", range(30))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    n, top = int(rng.integers(0, 300)), int(rng.choice([1, 5, 100, 10**6, 2**62]))
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    e, _ = EliasFano.read(b"".join(p.tobytes() for p in EliasFano.build(v).parts()), 0)
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate([rng.integers(0, top + 3, 50, dtype=np.uint64), v, v + np.uint64(1), np.array([2**62 + 5], np.uint64)])
    assert (e.successor(q) == np.searchsorted(v, q)).all()
    assert (e.index(q) == np.where(np.isin(q, v), np.searchsorted(v, q), -1)).all()


def test_trie_of_three_orders():
    rng = np.random.default_rng(4)
    grams = rng.integers(0, 30, (400, 3))
    orders = [(g := np.unique(grams[:, :k], axis=0), rng.normal(size=len(g))) for k in (1, 2, 3)]
    trie = NGramTrie.build(orders).mapped()
    for k, (table, values) in enumerate(orders, 1):
        q = rng.integers(0, 32, (500, k))
        place = {tuple(r): i for i, r in enumerate(table.tolist())}
        at = trie.find(q)
        assert at.tolist() == [place.get(tuple(r), -1) for r in q.tolist()]
        assert np.abs(trie.values(k - 1, np.arange(len(table))) - values).mean() < 0.03
        assert np.isnan(trie.values(k - 1, np.array([-1]))).all()
    lo, hi = trie.children(1, np.arange(len(orders[0][0])))
    assert (hi - lo).sum() == len(orders[1][0])
    with pytest.raises(ValueError):
        NGramTrie.build([(np.array([[1]]), [0.0]), (np.array([[2, 3]]), [0.0])])


def test_few_values_are_kept_exactly():
    values = np.log10(np.random.default_rng(0).integers(1, 200, 5000))
    book, codes = Quantised.build(values)
    assert np.array_equal(book[codes], values)


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("budget", [0, 3, 7])
def test_trie_join(seed, budget):
    rng = np.random.default_rng(seed)
    w = int(rng.integers(1, 3))
    base = rng.integers(0, 2**63, (4, w), dtype=np.uint64)
    rows = set()
    for _ in range(int(rng.integers(1, 60))):
        r = base[rng.integers(4)].copy()
        for _ in range(int(rng.integers(0, 6))):
            r[rng.integers(w)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        rows.add((int(rng.integers(3)), *map(int, r)))
    rows = sorted(rows)
    group, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], np.uint64).reshape(-1, w)
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if group[i] == group[j] and np.bitwise_count(x[i] ^ x[j]).sum() <= budget}
    assert {tuple(sorted(p)) for p in all_links(x, group, budget)} == want

    def classes(links):
        parent = list(range(len(rows)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in links:
            parent[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(rows))]

    some = spanning_links(x, group, budget)
    assert classes(some) == classes(want) and len(some) < max(1, len(rows))
