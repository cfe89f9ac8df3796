"""Blocks of documents and many queries: the k best are those of a plain reading, and few pairs are scored one by one."""

import numpy as np
import pytest

from tidepool.operators import dense

TREES = [["AND", 0, 1], ["NOT", ["OR", 0, 1], 2], ["OR", 0, ["NOT", 1, 2]], "any", 0, ["AND", 0, ["OR", 1, 2]]]


def made(seed, n_docs, n_queries, n_leaves, power):
    """Hits of documents (leaf j is in a share of (j + 1) ** -power), queries of three leaves, a tree each or none."""
    rng = np.random.default_rng(seed)
    there = rng.random((n_docs, n_leaves)) < (1.0 + np.arange(n_leaves)) ** -power
    weight = np.round(rng.random((n_docs, n_leaves)) * 3 + 1e-6, 1 + seed % 2) + 0.01
    query, leaf, number, tree = [], [], [], rng.integers(-1, len(TREES), n_queries)
    for q in range(n_queries):
        n = 1 if tree[q] == 4 else 2 if tree[q] == 0 else 3
        query += [q] * n
        leaf += rng.choice(n_leaves, n, replace=False).tolist()
        number += range(n)
    return there, weight, dense.Asked(n_queries, np.array(query), np.array(leaf), np.array(number), tree, TREES, there.sum(0).astype(float)), np.array(query), np.array(leaf), tree


def scored(there, weight, asked, k, step):
    scorer, pairs = dense.Scorer(asked, k), []
    plain = scorer.exact
    scorer.exact = lambda who, row, check: (pairs.append(len(who)), plain(who, row, check))
    for low in range(0, len(there), step):
        doc, leaf = np.nonzero(there[low : low + step])
        scorer.add(np.arange(low, min(low + step, len(there))) * 3, doc, leaf, weight[low : low + step][doc, leaf])
    return list(zip(*[x.tolist() for x in scorer.rows()], strict=True)), sum(pairs)


@pytest.mark.parametrize("seed, step, few, numbers", [(0, 100, 64, 1 << 24), (1, 100, 4, 1 << 24), (2, 37, 1, 1 << 24), (3, 300, 10**6, 1 << 24), (4, 100, 10**6, 200), (5, 3, 64, 1 << 24)])
def test_best_by_plain_reading(monkeypatch, seed, step, few, numbers):
    monkeypatch.setattr(dense, "FEW", few)
    monkeypatch.setattr(dense, "NUMBERS", numbers)
    monkeypatch.setattr(dense, "AT_ONCE", 1000)
    there, weight, asked, query, leaf, tree = made(seed, 300, 90, 40, 0.7)
    got, _ = scored(there, weight, asked, 7, step)
    want = []
    for q in range(90):
        own = leaf[query == q]
        found = []
        for d in range(300):
            mask = sum(int(there[d, x]) << n for n, x in enumerate(own))
            shape = None if tree[q] < 0 else TREES[tree[q]]
            if mask + 1 == 1 << len(own) if shape is None else mask > 0 if shape == "any" else dense.holds(shape, mask):
                found.append((q, 3 * d, float(np.floor((there[d, own] * weight[d, own]).sum() * 1e6 + 0.5) / 1e6)))
        want += sorted(found, key=lambda x: (-x[2], x[1]))[:7]
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_few_pairs_are_scored(monkeypatch):
    # as many as queries times documents with their words were scored one by one
    there, weight, asked, query, leaf, tree = made(6, 4000, 200, 20, 0.4)
    _, pairs = scored(there, weight, asked, 5, 1000)
    matched = sum(int(there[:, leaf[query == q]].any(1).sum()) for q in range(200))
    assert pairs * 20 < matched


def test_blocks_are_bounded():
    assert dense.blocks_of(np.array([10] * 5000)) == [(0, 2048), (2048, 4096), (4096, 5000)]
    assert dense.blocks_of(np.array([dense.WORDS, dense.WORDS, 5])) == [(0, 1), (1, 2), (2, 3)]
    assert dense.cover(["AND", 0, ["OR", 1, 2]], {0: 9, 1: 2, 2: 3}) == (5, [1, 2])
