"""Boolean, phrase and prefix queries against a plain reading of them, text by text."""

import math
import re

import numpy as np
import pytest

from tidepool.operators import boolean, inverted

QUERIES = [
    "w1 AND w2", "w1 w2", "w1 OR w7", "w1 NOT w2", "(w3 OR w4) NOT w1", '"w1 w2"', '"w2 w1 w1"', "w1*", "w2* AND w3", '"w1 w2" OR w9 NOT w1', "w1 w2 NOT w3 w4", "w5-w1", "a OR b", "W1 And w2", "NOT w1", "w1 AND", "(w1", "w1)",
    '"w1', "", None, "zzz*", '"w1 zzz"', "w1 AND (w2 OR (w3 NOT w4))", "-- w1", '""',
]


def occurrences(kind, words, text):
    if kind == "prefix":
        return sum(t.startswith(words[0]) for t in text)
    return sum(text[k : k + len(words)] == words for k in range(len(text)))


def plain(rows, query, k):
    parsed = boolean.read(query)
    if not parsed:
        return []
    texts = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in rows}
    average = sum(map(len, texts.values())) / len(texts)
    counts = [{i: occurrences(*leaf, text) for i, text in texts.items()} for leaf in parsed.leaves]
    out = []
    for i, text in texts.items():
        score = 0.0
        for own in counts:
            df = sum(c > 0 for c in own.values())
            if own[i]:
                idf = max(math.log((len(texts) - df + 0.5) / (df + 0.5)), 1e-6)
                score += idf * own[i] * 2.2 / (own[i] + 1.2 * (0.25 + 0.75 * len(text) / average))
        if boolean.holds(parsed.tree, sum((own[i] > 0) << n for n, own in enumerate(counts))):
            out.append((i, round(score, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


def test_queries_by_plain_reading(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.integers(1, 14, rng.integers(0, 25)))) for k in range(120)] + [(900, None), (901, "w1 w2 a well w1 And")]
    index = inverted.Index(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame(rows[:70], "id long, searchable_text string"))
    index.append(spark.createDataFrame(rows[70:], "id long, searchable_text string"))
    index.delete(spark.createDataFrame([(3,), (80,)], "id long"))
    left = [r for r in rows if r[0] not in (3, 80)]
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    got = {}
    for r in sorted(boolean.search(index, asked, 1000).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.memory_id, r.score))
    for n, q in enumerate(QUERIES):
        want = plain(left, q, 1000)
        assert [i for i, _ in got.get(n, [])] == [i for i, _ in want], q
        assert [s for _, s in got.get(n, [])] == pytest.approx([s for _, s in want], abs=2e-6)
    assert sum(bool(plain(left, q, 9)) for q in QUERIES) >= 14


@pytest.mark.parametrize(
    "query, tree",
    [("a b NOT c", ["NOT", ["AND", 0, 1], 2]), ("a OR b AND c", ["OR", 0, ["AND", 1, 2]]), ("a AND b NOT c", ["AND", 0, ["NOT", 1, 2]]), ("(a OR b) c", ["AND", ["OR", 0, 1], 2]), ("a NOT b NOT c", ["NOT", ["NOT", 0, 1], 2])],
)
def test_precedence(query, tree):
    assert boolean.read(query).tree == tree
