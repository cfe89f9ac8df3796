"""What SQL does not say: stems, chunks, near-duplicate suppression, odd rows."""

import numpy as np
import pytest

from tidepool.functions.stem import porter
from tidepool.operators import ingest, rank, search
from tidepool.queries import QUERIES
from tidepool.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "words",
    [
        "caresses caress, ponies poni, ties ti, cats cat, feed feed, agreed agre, plastered plaster, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop",
        "falling fall, hissing hiss, filing file, happy happi, sky sky, relational relat, conditional condit, triplicate triplic, formative form, hopefulness hope, goodness good, revival reviv",
        "allowance allow, adjustable adjust, replacement replac, adoption adopt, probate probat, rate rate, cease ceas, controll control, roll roll, as as, authentication authent, authenticated authent",
    ],
)
def test_stems(words):
    for pair in words.split(", "):
        word, want = pair.split()
        assert porter(word) == want


def test_stemmed_search(spark):
    m = spark.createDataFrame([(1, "authentication failed"), (2, "was authenticated successfully"), (3, "garden"), (4, None), (5, "more words"), (6, "other words")], "id long, searchable_text string")
    q = spark.createDataFrame([(1, "authenticate"), (2, "gardens authenticate")], "query_id long, query string")
    assert {(r.query_id, r.memory_id) for r in search.bm25(m, q, stemmed=True).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)}
    assert search.bm25(m, q).count() == 0


def test_suppression(spark):
    v = {r.memory_id: np.array(r.embedding) for r in tables.vectors(spark, SF).collect()}
    got = {(r.query_id, r.memory_id) for r in QUERIES["near_duplicate_suppression"](spark, SF).collect()}
    want = set()
    for q in range(25):
        kept = []
        for m in sorted((m for m in v if m % 25 == q), key=lambda m: (-(1.0 - m % 97 / 100), m)):
            if all(float(v[m] @ v[k]) <= 0.3 for k in kept):
                kept.append(m)
        want |= {(q, m) for m in kept}
    assert got == want and len(want) < len(v)


def test_chunks():
    assert ingest.chunks_of([]) == [] and ingest.chunks_of([("user", "short")]) == []
    turns = [("user", f"turn {k} says é something of some length") for k in range(40)]
    found = ingest.chunks_of(turns, "2024-01-01", 300)
    assert sum(n for _, n in found) == 40 and all(x.startswith("[Session from 2024-01-01]\n") and len(x.encode()) < 600 for x, _ in found)
    assert all(any(t in x for x, _ in found) for _, t in turns)
    long = "é" * 1000 + " tail of it all"
    assert "".join(x for x, _ in ingest.chunks_of([("user", long)], "", 101, 1)) == f"user: {long}\n"


def test_session_chunks(spark):
    got = {}
    for r in QUERIES["session_chunks"](spark, SF).orderBy("conv_id", "chunk").collect():
        got.setdefault(r.conv_id, []).append((r.text, r.n_turns))
    turns = {}
    for r in tables.read(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert got == {k: c for k, t in turns.items() if (c := ingest.chunks_of(t))}


def test_head_and_tail(spark):
    c = spark.createDataFrame([(1, k, float(k)) for k in range(6)], "query_id long, memory_id long, score double")
    got = rank.rerank_head(c, -c["score"] / 10, 3).orderBy("rank").collect()
    assert [r.memory_id for r in got] == [3, 4, 5, 2, 1, 0] and got[3].score == 2.0


def test_suppression_judges_whole_lists(spark):
    """Two lists of 330 and 5 rows, in one block and in several, against brute force; some rows have no vector."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(330, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[300:] = v[:30]  # exact copies of early rows, past any block of theirs
    lists = [(q, m, 1.0 - m / 1000) for q, n in ((1, 330), (None, 5)) for m in range(n)]
    c = spark.createDataFrame(lists, "query_id long, memory_id long, score double")
    vectors = spark.createDataFrame([(k, None if k % 50 == 7 else x.tolist()) for k, x in enumerate(v)], "memory_id long, embedding array<double>")
    want = set()
    for q, n in ((1, 330), (None, 5)):
        seen = []
        for m in range(n):
            if m % 50 == 7 or all(float(v[m] @ v[s]) <= 0.9 for s in seen):
                want.add((q, m))
                seen += [] if m % 50 == 7 else [m]
    for block in (2000, 70):
        assert {(r.query_id, r.memory_id) for r in rank.suppress_near_duplicates(c, vectors, 0.9, block=block).collect()} == want
    assert len(want) > 205 and (1, 300) not in want
    assert rank.suppress_near_duplicates(c.where("false"), vectors).count() == 0
