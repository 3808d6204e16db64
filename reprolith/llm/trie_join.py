"""Self-join of fingerprints within a Hamming budget, over binary tries.

``BinaryTrie`` is a path-compressed binary trie over sorted fingerprints of any number of 64-bit
words, many groups at a time. The join starts at the two children of every inner node and goes down
node pairs together: each pair carries the bits in which its prefixes differ, and is dropped as soon
as these exceed the budget. Pairs of leaves that are left are links. The frontier is an array; node
pairs are taken in blocks, so memory is bounded.

``spanning_links`` needs only what connects: it keeps a union-find over the leaves, and drops a pair
of nodes whose leaves are all in one component already. So a group of thousands of near copies
costs about its size, not its square, and gives fewer links than it has members. No link between
different components is lost, so the components are those of all links.
"""

from __future__ import annotations

import numpy as np

#: Node pairs that are expanded at a time.
BLOCK = 1 << 16


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that rows of a and b (n x words of uint64) have in common."""
    n, words = a.shape
    out = np.full(n, 64 * words, np.int64)
    open_ = np.ones(n, bool)
    for w in range(words):
        x = a[:, w] ^ b[:, w]
        hit = open_ & (x != 0)
        if hit.any():
            v = x[hit]
            bits = np.zeros(len(v), np.int64)
            for s in (32, 16, 8, 4, 2, 1):
                big = v >> np.uint64(s) != 0
                bits[big] += s
                v = np.where(big, v >> np.uint64(s), v)
            out[hit] = 64 * w + 63 - bits
            open_ &= ~hit
    return out


class BinaryTrie:
    """Nodes 0..n-1 are leaves, later ones inner nodes; `rows` are distinct and sorted within groups."""

    def __init__(self, rows: np.ndarray, group: np.ndarray):
        n, words = rows.shape
        self.rows, self.n, self.words = rows, n, words
        lcp = common_bits(rows[1:], rows[:-1]) if n > 1 else np.zeros(0, np.int64)
        lcp[group[1:] != group[:-1]] = -1
        left, right, depth, lo, hi = [], [], [], [], []
        # the right edge: [node, first leaf, depth at which it meets its right neighbour]
        stack: list[list[int]] = [[0, 0]]

        def join(upto: int) -> None:
            """The last two nodes of the edge become children of a new one."""
            r, l = stack.pop(), stack.pop()
            for col, v in ((left, l[0]), (right, r[0]), (depth, l[2]), (lo, l[1]), (hi, upto)):
                col.append(v)
            stack.append([n + len(left) - 1, l[1]])

        for i, d in enumerate(lcp.tolist(), 1):
            while len(stack) > 1 and stack[-2][2] > d:
                join(i)
            if d < 0:
                stack.clear()
            else:
                stack[-1].append(d)
            stack.append([i, i])
        while len(stack) > 1:
            join(n)
        leaf = np.arange(n)
        none = np.full(n, -1, np.int64)
        self.left = np.concatenate([none, np.array(left, np.int64)])
        self.right = np.concatenate([none, np.array(right, np.int64)])
        self.depth = np.concatenate([np.full(n, 64 * words, np.int64), np.array(depth, np.int64)])
        self.lo = np.concatenate([leaf, np.array(lo, np.int64)])
        self.hi = np.concatenate([leaf + 1, np.array(hi, np.int64)])

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the prefixes of node pairs differ, as far as both reach."""
        upto = np.minimum(self.depth[a], self.depth[b])
        ra, rb = self.rows[self.lo[a]], self.rows[self.lo[b]]
        total = np.zeros(len(a), np.int64)
        for w in range(self.words):
            keep = np.clip(upto - 64 * w, 0, 64)
            x = ra[:, w] ^ rb[:, w]
            x = np.where(keep == 0, np.uint64(0), x >> ((64 - keep) % 64).astype(np.uint64))
            total += np.bitwise_count(x)
        return total

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """The children of every inner node, deepest nodes last."""
        inner = np.arange(self.n, len(self.left))
        inner = inner[np.argsort(self.depth[inner], kind="stable")]
        return self.left[inner], self.right[inner]

    def expand(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair with the children of its shallower node in its place."""
        down_a = self.depth[a] <= self.depth[b]
        aa, bb = np.where(down_a, self.left[a], a), np.where(down_a, b, self.left[b])
        a2, b2 = np.where(down_a, self.right[a], a), np.where(down_a, b, self.right[b])
        return np.concatenate([aa, a2]), np.concatenate([bb, b2])


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _flat(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent[:] = up


def spanning_links(rows: np.ndarray, group: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Index pairs that connect rows of one group as all pairs within `budget` bits would."""
    trie = BinaryTrie(rows, group)
    parent = np.arange(trie.n)
    links: list[tuple[int, int]] = []
    a, b = trie.start()
    stack = [(a[i : i + BLOCK], b[i : i + BLOCK]) for i in range(0, len(a), BLOCK)]
    first = uniform = None
    stale = True
    while stack:
        a, b = stack.pop()
        if stale:
            _flat(parent)
            first, uniform, stale = parent[trie.lo], _uniform(trie, parent), False
        keep = ~(uniform[a] & uniform[b] & (first[a] == first[b]))
        a, b = a[keep], b[keep]
        keep = trie.differing(a, b) <= budget
        a, b = a[keep], b[keep]
        leaf = (a < trie.n) & (b < trie.n)
        if leaf.any():
            for x, y in zip(a[leaf].tolist(), b[leaf].tolist(), strict=True):
                rx, ry = _find(parent, x), _find(parent, y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    links.append((x, y))
                    stale = True
            a, b = a[~leaf], b[~leaf]
        if len(a):
            a, b = trie.expand(a, b)
            stack += [(a[i : i + BLOCK], b[i : i + BLOCK]) for i in range(0, len(a), BLOCK)]
    return links


def _uniform(trie: BinaryTrie, label: np.ndarray) -> np.ndarray:
    """Whether all leaves of a node have one label."""
    change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    return change[trie.hi - 1] == change[trie.lo]


def all_links(rows: np.ndarray, group: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Every index pair of one group within `budget` bits (for small inputs and tests)."""
    trie = BinaryTrie(rows, group)
    out: list[tuple[int, int]] = []
    stack = [trie.start()]
    while stack:
        a, b = stack.pop()
        keep = trie.differing(a, b) <= budget
        a, b = a[keep], b[keep]
        leaf = (a < trie.n) & (b < trie.n)
        out += zip(a[leaf].tolist(), b[leaf].tolist(), strict=True)
        if (~leaf).any():
            a, b = trie.expand(a[~leaf], b[~leaf])
            stack += [(a[i : i + BLOCK], b[i : i + BLOCK]) for i in range(0, len(a), BLOCK)]
    return out
