"""The k best documents of many queries, where the documents' hits are read.

Documents come in blocks. A query is led to documents by leaves of which any match has one (of a query of all its leaves: the one with the fewest hits in the block). Where these hits
are few, each pair of a hit and a query is scored; where they are many, the query's sums over all documents of the block are added up, row by row of a matrix of leaves
and documents, many queries at once, in single precision. Only what may be among a query's k best (what is known of them in this task) is then scored in full. So frequent words cost
an addition a document instead of a join, and no score differs from that of a plain sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tidepool.operators.search import CELLS, Best, steps_of

#: Documents and words of a block at most; a leaf is frequent with more than a FEWth of the block's documents; numbers of the matrix, and of the sums at once.
DOCS, WORDS, FEW, NUMBERS, AT_ONCE = 2048, 1 << 20, 64, 1 << 24, 1 << 18
#: What single precision and rounding to six places may hide of a score.
SHARE, LEAST = 1e-5, 2e-6


def holds(tree, mask: int) -> bool:
    """Whether a set of leaves (bits) will do."""
    if isinstance(tree, int):
        return bool(mask >> tree & 1)
    operator, left, right = tree
    if operator == "OR":
        return holds(left, mask) or holds(right, mask)
    return holds(left, mask) and holds(right, mask) == (operator == "AND")


def cover(tree, df: dict[int, float]) -> tuple[float, list[int]]:
    """Leaves of which any match has one, as rare as possible, and their frequencies' sum."""
    if isinstance(tree, int):
        return df.get(tree, 0.0), [tree]
    operator, left, right = tree
    if operator == "NOT":
        return cover(left, df)
    a, b = cover(left, df), cover(right, df)
    return (a[0] + b[0], a[1] + b[1]) if operator == "OR" else min(a, b, key=lambda x: x[0])


def blocks_of(size: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that make a block."""
    return steps_of(np.maximum(size, WORDS // DOCS), WORDS)


def lists(starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The places of what each of the numbers has, list after list."""
    many = starts[numbers + 1] - starts[numbers]
    return np.arange(many.sum()) + np.repeat(starts[numbers] + many - np.cumsum(many), many)


class Asked:
    """Queries (numbers from 0) with their leaves (numbers from 0), each with its number in the query's tree. tree: of each query the place in trees, -1: all leaves; a tree is
    "any" or one of holds(). df: documents with each leaf."""

    def __init__(self, n: int, query: np.ndarray, leaf: np.ndarray, number: np.ndarray, tree: np.ndarray, trees: list, df: np.ndarray):
        order = np.lexsort((number, query))
        self.n, self.n_leaves, self.tree, self.trees = n, len(df), tree, trees
        self.query, self.leaf, number = query[order], leaf[order], number[order]
        self.bit = np.where(np.isin(tree[self.query], [k for k, x in enumerate(trees) if x != "any"]), 1 << (number % 64), 1)
        self.first = np.searchsorted(self.query, np.arange(n + 1))
        # rows that lead to a query, where its tree says which
        leads, of_group = np.ones(len(query), bool), {}
        for q in range(n):
            low, high = self.first[q], self.first[q + 1]
            own = tuple(number[low:high].tolist()) if tree[q] >= 0 and trees[tree[q]] != "any" else (high - low,)
            if len(own) and tree[q] >= 0 and trees[tree[q]] != "any":
                found = set(cover(trees[tree[q]], dict(zip(own, df[self.leaf[low:high]].tolist(), strict=True)))[1])
                leads[low:high] = [x in found for x in own]
            if high > low:
                of_group.setdefault((int(tree[q]), own), []).append(q)
        self.leading = np.flatnonzero(leads)
        self.groups = [(key[0], key[1], np.array(own, np.int64)) for key, own in of_group.items()]


class Scorer:
    def __init__(self, asked: Asked, k: int):
        self.asked, self.k, self.best = asked, k, Best(asked.n, k)
        self.known: dict[tuple[int, int], bool] = {}
        self.place = np.zeros(asked.n_leaves, np.int64)

    def add(self, members: np.ndarray, doc: np.ndarray, leaf: np.ndarray, weight: np.ndarray) -> None:
        """A block: ids of its documents, and its hits in order of document (a place in members) and leaf."""
        if not len(doc):
            return
        a, n = self.asked, len(members)
        self.members, self.weight, self.key = members, weight, doc * a.n_leaves + leaf
        self.limit = self.best.least * (1 - SHARE) - LEAST
        # hits by leaf
        self.by = np.argsort(leaf, kind="stable")
        present, begin, many = np.unique(leaf[self.by], return_index=True, return_counts=True)
        count, most = np.zeros(a.n_leaves, np.int64), np.zeros(a.n_leaves)
        count[present], most[present] = many, np.maximum.reduceat(weight[self.by], begin)
        self.doc, self.starts = doc, np.zeros(a.n_leaves + 1, np.int64)
        np.cumsum(count, out=self.starts[1:])

        of_row, bound = count[a.leaf], np.bincount(a.query, most[a.leaf], a.n)
        led = np.bincount(a.query[a.leading], of_row[a.leading], a.n)
        whole = a.tree < 0
        if whole.any():
            least = np.full(a.n, np.iinfo(np.int64).max)
            np.minimum.at(least, a.query, of_row)
            led = np.where(whole, least, led)
        live = (led > 0) & (bound >= self.limit)
        few = live & (led * FEW <= n)

        rows = a.leading[few[a.query[a.leading]]]
        rows = rows[(of_row[rows] > 0) & (~whole[a.query[rows]] | (of_row[rows] == led[a.query[rows]]))]
        if len(rows):  # of a query of all leaves the first of the rarest
            rows = rows[~whole[a.query[rows]] | (np.diff(a.query[rows], prepend=-1) > 0)]
        for low, high in steps_of(of_row[rows], CELLS // 8):
            own = rows[low:high]
            hit = self.by[lists(self.starts, a.leaf[own])]
            who = np.repeat(a.query[own], of_row[own])
            rest = np.repeat((bound - self.limit)[a.query[own]] - most[a.leaf[own]], of_row[own])
            good = weight[hit] + rest >= -LEAST
            self.exact(*np.divmod(np.unique(who[good] * n + doc[hit[good]]), n), True)

        many_hits = live & ~few
        if not many_hits.any():
            return
        self.place[:] = 0
        own = present[(many * FEW > n)]
        own = own[np.argsort(-count[own], kind="stable")][: NUMBERS // n]
        self.place[own] = np.arange(1, len(own) + 1)
        matrix = np.zeros((len(own) + 1, n), np.float32)
        at = self.place[leaf]
        matrix[at, doc] = weight
        matrix[0] = 0
        for tree, numbers, queries in a.groups:
            queries = queries[many_hits[queries]]
            for low in range(0, len(queries), max(1, AT_ONCE // n)):
                self.sums(tree, numbers, queries[low : low + max(1, AT_ONCE // n)], matrix, count)

    def sums(self, tree: int, numbers: tuple[int, ...], queries: np.ndarray, matrix: np.ndarray, count: np.ndarray) -> None:
        """Queries of one tree, over all documents of the block."""
        a, n = self.asked, matrix.shape[1]
        shape, total, there = None if tree < 0 else a.trees[tree], None, {}
        for j in range(a.first[queries[0] + 1] - a.first[queries[0]]):
            leaf = a.leaf[a.first[queries] + j]
            own = matrix[self.place[leaf]]
            for r in np.flatnonzero((self.place[leaf] == 0) & (count[leaf] > 0)):
                hit = self.by[self.starts[leaf[r]] : self.starts[leaf[r] + 1]]
                own[r, self.doc[hit]] = self.weight[hit]
            if shape is None:
                good = own > 0 if total is None else good & (own > 0)
            elif shape != "any":
                there[numbers[j]] = own > 0
            if total is None:
                total = own
            else:
                total += own
        if shape == "any":
            good = total > 0
        elif shape is not None:
            good = self.told(shape, there, total.shape)
        limit = self.limit[queries].astype(np.float32)
        if len(open_ := np.flatnonzero(np.isinf(limit))) and n > self.k:  # what is below the k-th best of these documents is not among the best
            open_ = open_[good[open_].sum(1) > self.k]
            if len(open_):
                own = np.where(good[open_], total[open_], -np.inf)
                limit[open_] = np.partition(own, n - self.k, axis=1)[:, n - self.k] * (1 - SHARE) - LEAST
        good &= total >= limit[:, None]
        who, row = np.divmod(np.flatnonzero(good), n)
        self.exact(queries[who], row, False)

    def told(self, tree, there: dict[int, np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        if isinstance(tree, int):
            return there[tree] if tree in there else np.zeros(shape, bool)
        left, right = self.told(tree[1], there, shape), self.told(tree[2], there, shape)
        return left | right if tree[0] == "OR" else left & right if tree[0] == "AND" else left & ~right

    def exact(self, who: np.ndarray, row: np.ndarray, check: bool) -> None:
        """Scores pairs of a query and a document. check: whether these match is not known yet."""
        a = self.asked
        for low in range(0, len(who), CELLS // 8):
            q, r = who[low : low + CELLS // 8], row[low : low + CELLS // 8]
            many = a.first[q + 1] - a.first[q]
            wanted, of_row = np.repeat(r, many) * a.n_leaves, lists(a.first, q)
            wanted += a.leaf[of_row]
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found, starts = self.key[place] == wanted, np.cumsum(many) - many
            sums = np.add.reduceat(np.where(found, self.weight[place], 0.0), starts)
            if check:
                good, tree = np.ones(len(q), bool), a.tree[q]
                whole = tree < 0
                good[whole] = (np.add.reduceat(found.astype(np.int64), starts) == many)[whole]
                told = np.flatnonzero(~whole & np.array([x != "any" for x in a.trees] or [False])[tree])
                if len(told):
                    mask = np.add.reduceat(np.where(found, a.bit[of_row], 0), starts)
                    pairs, inverse = np.unique(np.stack([tree[told], mask[told]]), axis=1, return_inverse=True)
                    pairs = list(map(tuple, pairs.T.tolist()))
                    for pair in pairs:
                        if pair not in self.known:
                            self.known[pair] = holds(a.trees[pair[0]], pair[1])
                    good[told] = np.array([self.known[pair] for pair in pairs], bool)[inverse.ravel()]
                    if len(self.known) > 1 << 16:
                        self.known.clear()
                q, r, sums = q[good], r[good], sums[good]
            self.best.add(q, self.members[r], np.floor(sums * 1e6 + 0.5) / 1e6)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id, score of the k best."""
        return self.best.rows()
