"""The whole search on small tables, writes, texts for embedding, and queries in blocks."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import ann, lifecycle, retrieve, search, state

NOW = "TIMESTAMP_NTZ'2024-03-01 00:00:00'"
MEMORIES = "id long, searchable_text string, memory_type string, importance int, created_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, source_trust string, source_kind string, source_verification string"
EDGES = "source_id long, target_id long, relation string, confidence double, valid_until timestamp_ntz"


def memory(i, text, day=1, trust="normal", kind="semantic", until=None):
    return (i, text, kind, 5, datetime(2024, 2, day), None, until, trust, "other", "none")


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        memory(1, "The relay host was alpha before", 1),
        memory(2, "The relay host is beta now", 20),
        memory(3, "Gardens are green and the relay is loud", 10),
        memory(4, "relay host gamma, an old plan", 3, until=datetime(2024, 2, 10)),
        memory(5, "Nothing to see", 5),
        memory(6, None, 6),
    ]
    return spark.createDataFrame(rows, MEMORIES), spark.createDataFrame([(1, 2, "superseded_by", 1.0, None)], EDGES)


def plan_of(spark, *rows):
    return spark.createDataFrame(list(rows), retrieve.PLAN)


def test_states_turn_the_order(spark, store):
    m, edges = store
    rows = [(1, "relay host", "keyword-any", "newer", "current", False, False, False), (2, "relay host", "keyword-any", "older", "historical", False, False, False), (3, "alpha", "keyword-any", "neutral", "current", False, False, False), (4, "alpha", "keyword-any", "neutral", "neutral", False, False, False), (5, None, "keyword", "neutral", "neutral", False, False, False)]
    got = {}
    for r in retrieve.retrieve(plan_of(spark, *rows), m, edges, F.expr(NOW)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    assert got[1][0] == 2 and got[2][0] == 1 and 4 not in got[1]  # no longer valid
    assert set(got[3]) == {1, 2} and got[4] == [1]  # the successor joins where the current state is asked for
    assert 5 not in got and retrieve.retrieve(plan_of(spark), m, edges, F.expr(NOW)).count() == 0


def test_modes(spark, store):
    m, edges = store
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (5, [0.8, 0.6])], "memory_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(1, 7)], "query_id long, embedding array<double>")
    rows = [(n, "relay host", mode, "neutral", "neutral", strict, False, False) for n, (mode, strict) in enumerate([("keyword", False), ("keyword-any", False), ("vector", False), ("hybrid", False), ("exhaustive", False), ("keyword-any", True)], 1)]
    got = {}
    for r in retrieve.retrieve(plan_of(spark, *rows), m, edges, F.expr(NOW), 1, vectors, asked).collect():
        got.setdefault(r.query_id, set()).add(r.memory_id)
    assert got[1] <= {1, 2} and got[3] == {2} and got[4] <= {1, 2}  # the newer of two near ones
    assert got[5] == {1, 2, 3} and len(got[6]) == 1
    without = retrieve.found(plan_of(spark, *rows), m, 2)
    assert {r.query_id for r in without.collect()} == {1, 2, 3, 4, 5, 6}


def test_routes_lead_to_modes(spark):
    q = spark.createDataFrame([(1, "How many sessions failed?"), (2, "What is the latest plan?"), (3, None), (4, "What is the approved staging port?")], "query_id long, query string")
    got = {r.query_id: (r.mode, r.state) for r in retrieve.routed(q).collect()}
    assert got == {1: ("exhaustive", "neutral"), 2: ("hybrid", "current"), 3: ("hybrid", "neutral"), 4: ("keyword-any", "neutral")}


def test_blocks_of_queries_change_nothing(spark, store, monkeypatch):
    m, _ = store
    q = spark.createDataFrame([(k, t) for k, t in enumerate(["relay host", "green gardens", "beta", "nothing old", "the"])], "query_id long, query string")
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(30)], "memory_id long, embedding array<double>")
    asked = v.where("memory_id < 9").withColumnRenamed("memory_id", "query_id")
    centres = ann.train(v, 4)

    def answers():
        return [sorted(map(tuple, x.collect())) for x in (search.bm25(m, q), search.bm25(m, q, stemmed=True), search.vector_topk(v, asked, 3), ann.search(ann.build(v, centres), centres, asked, 3, 4))]

    whole = answers()
    assert len(whole[0]) > 3 and [r[:3] for r in whole[2]] == [r[:3] for r in whole[3]]
    monkeypatch.setattr(search, "MOST_TERMS", 2)
    monkeypatch.setattr(search, "MOST_NUMBERS", 8)
    monkeypatch.setattr(ann, "MOST_NUMBERS", 8)
    assert answers() == whole


def test_update_touches_only_its_rows(spark):
    m = spark.createDataFrame([(1, "a", "h", "pending"), (2, "b", "h", "failed"), (3, "c", "h", "success"), (4, None, None, None)], "id long, searchable_text string, content_hash string, embedding_status string")
    c = spark.createDataFrame([(3, "new", "x"), (2, None, "x"), (9, "nowhere", "x")], "id long, searchable_text string, content_hash string")
    got = {r.id: tuple(r)[1:] for r in lifecycle.update(m, c).collect()}
    hashed = spark.range(1).select(tx.content_hash(F.lit("new"))).first()[0]
    assert got == {1: ("a", "h", "pending"), 2: (None, None, "pending"), 3: ("new", hashed, "pending"), 4: (None, None, None)}


def test_texts_for_embedding(spark):
    texts = ["short", "ab cd ef", "日本語" * 20, "é" * 9 + " x", "a" * 30, None, "日 本 語 語 語"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.for_embedding(F.col("t"), 10)).collect()]

    def plain(t):
        if t is None or len(t.encode()) <= 10:
            return t
        cut = t.encode()[:10].decode("utf-8", "ignore")
        at = max(cut.rfind(" "), 0)
        return cut[:at] or cut

    assert got == [plain(t) for t in texts]


def test_relations(spark):
    edges = spark.createDataFrame([(1, 2, "related_to", 0.5, None)], EDGES)
    new = spark.createDataFrame([(1, 2, "related_to", 0.9, None), (2, 3, "related_to", 0.8, None), (2, 3, "related_to", 0.8, None)], EDGES)
    both = state.relate(edges, new)
    assert sorted((r.source_id, r.target_id, r.confidence) for r in both.collect()) == [(1, 2, 0.5), (2, 3, 0.8)]
    assert [r.source_id for r in state.unrelate(both, edges).collect()] == [2]
    seeds = spark.createDataFrame([(7, 1, 1.0)], "query_id long, memory_id long, score double")
    reached = state.traverse(seeds.select(F.col("memory_id").alias("seed")), both, F.expr(NOW), 2)
    assert {r.memory_id: r.score for r in state.graph_scores(seeds, reached).collect()} == pytest.approx({1: 1.0, 2: 0.5 * 0.9, 3: 1 / 3 * 0.9}, rel=0.4)
