"""The pairing of mixing and the trees of the quality rules against plain versions of themselves; statistics of rows that share a doc_id; very long turns."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidepool.llm import chat, mixing, quality
from tidepool.llm.trees import train


def plain_pairing(size, p, draw, kept_back):
    """Two open rows at a time: words move from one to the other until one is whole, upwards with the chance that keeps its mean. In fractions."""
    p = [Fraction(x).limit_denominator(1000) for x in p]
    carry = None
    for k in range(max(0, len(p) - kept_back)):
        if p[k] in (0, 1):
            continue
        if carry is None:
            carry = k
            continue
        i, j = carry, k
        up = min((1 - p[i]) * size[i], p[j] * size[j])
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if Fraction(draw[k]) < down / (up + down) else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        left = [m for m in (i, j) if p[m] not in (0, 1)]
        assert len(left) < 2
        carry = left[0] if left else None
    return p


@pytest.mark.parametrize("seed", range(6))
def test_pairing_in_fractions(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 90))
    size = np.sort(rng.integers(1, 400, n))[::-1]
    p = rng.integers(0, 21, n) / 20
    draw = rng.random(n)
    got = mixing.resolve(size.astype(float), p, draw, False)
    want = plain_pairing(size.tolist(), p, draw, mixing.KEPT_BACK)
    assert got == pytest.approx([float(x) for x in want], abs=1e-7)
    assert sum(w * s for w, s in zip(want, size.tolist(), strict=True)) == sum(Fraction(x).limit_denominator(1000) * s for x, s in zip(p, size.tolist(), strict=True))


def best_split(x, g, h, monotone, ridge=1.0, least=1.0):
    """All features, all thresholds between rows: (gain, feature, threshold, left rows), in plain loops."""
    best = (1e-6, -1, None, None)
    gs, hs = sum(g), sum(h)
    for f in range(len(x[0])):
        for t in sorted({row[f] for row in x})[:-1]:
            left = [k for k, row in enumerate(x) if row[f] <= t]
            gl, hl = sum(g[k] for k in left), sum(h[k] for k in left)
            gr, hr = gs - gl, hs - hl
            if hl < least or hr < least or monotone[f] * (gr / (hr + ridge) - gl / (hl + ridge)) < 0:
                continue
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, f, t, left)
    return best


@pytest.mark.parametrize("seed, monotone", [(0, [0, 0, 0]), (1, [1, 0, -1]), (2, [-1, -1, 0]), (3, [0, 1, 0])])
def test_stumps_by_exhaustive_splits(seed, monotone):
    """Trees of one split each, on thirty rows: every step takes the best split there is."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 15, (30, 3)).astype(float)
    y = (x[:, 0] + rng.normal(size=30) * 4 > 7).astype(float)
    forest = train(x, y, monotone, trees=5, depth=1, rate=0.3, bins=64)
    positive = (y.sum() + 0.5) / 31
    margin = [math.log(positive / (1 - positive))] * 30
    for root in forest.roots:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(y.tolist(), p, strict=True)], [a * (1 - a) for a in p]
        gain, f, t, left = best_split(x.tolist(), g, h, monotone)
        assert forest.feature[root] == f
        if f < 0:
            margin = [m + forest.value[root] for m in margin]
            continue
        own = [k for k in range(30) if x[k, f] <= forest.threshold[root]]
        assert own == left  # thresholds may differ between rows that no value lies between
        for side, rows in ((0, left), (1, [k for k in range(30) if k not in left])):
            value = 0.3 * sum(g[k] for k in rows) / (sum(h[k] for k in rows) + 1.0)
            assert forest.value[forest.left[root] + side] == pytest.approx(value)
            for k in rows:
                margin[k] += value
    assert forest.margin(x) == pytest.approx(margin)


def test_statistics_of_texts_under_one_doc_id(spark):
    """Each row is judged by its own text."""
    good, bad = "plain words that say something new each time " * 1 + " ".join(f"w{k}" for k in range(60)), "again and again " * 80
    docs = spark.createDataFrame([(1, good), (1, bad), (1, good), (None, good), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed) for r in quality.judge(docs, labels).collect())
    n = len(good.split())
    assert got == sorted([(1, n, False), (1, 240, True), (1, n, False), (0, n, False), (2, 0, True)])


def test_a_very_long_turn(spark):
    long = "a turn that goes on </s> and <|sep|> on " * 20_000
    df = spark.createDataFrame([(1, 0, "user", "short"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.read_conversations(chat.format_conversations(df)).first()
    assert (r.n_turns, r.loss_chars) == (2, len(long))
