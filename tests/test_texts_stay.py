"""Searches of many queries: few tasks write best rows, and texts do not travel with the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import grounding, policy, retrieve, search

ASKING = ["what is the current plan", "which script file is the source of truth", "is the token service approved", "what comes next", "what did not work before", "prefer one rather than another", "plain words", "how was it done earlier", "should the auth token be used", None]
SHOWING = ["The Current, active plan", "scripts/run.sh is the source of truth", "not prove it; cannot", "previously used to: prefer", "auth token credential 0.0.0.0", "next validation step before that", "", None, "supported except codex-cli"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(q, d, 1.0 + q + d / 7, False, True) for q in range(len(ASKING)) for d in range(len(SHOWING))], "query_id long, memory_id long, score double, strict_grounding boolean, alignment boolean")


def test_texts_are_looked_at_once(spark, rows):
    queries = spark.createDataFrame([(q, x, True) for q, x in enumerate(ASKING)], "query_id long, query string, alignment boolean")
    texts = spark.createDataFrame(list(enumerate(SHOWING)), "memory_id long, searchable_text string")
    got = {(r.query_id, r.memory_id): r.score for r in grounding.weighed(rows, queries, texts).collect()}
    want = {(r.query_id, r.memory_id): r.score for r in grounding.align(rows.join(texts, "memory_id"), queries).collect()}
    assert got == want and len(set(want.values())) > 40
    changed = {q for (q, d), score in want.items() if score != 1.0 + q + d / 7}
    assert 6 not in changed and {0, 1, 7} <= changed


def test_no_text_where_nothing_is_asked(spark, rows):
    broken = spark.range(9).select(F.col("id").alias("memory_id"), F.raise_error(F.lit("read")).cast("string").alias("searchable_text"))
    queries = spark.createDataFrame([(q, "plain words", "plain words", False, True) for q in range(len(ASKING))], "query_id long, query string, wording string, strict_grounding boolean, alignment boolean")
    assert retrieve.answering(rows, queries, broken).count() == len(ASKING) * len(SHOWING)


def test_conflicts_need_no_text(spark):
    texts = ["keep the supported way", "temporary workaround", "in production", "staging lab", "migration bridge", None]
    rows = [(q, d, 9.0, query, True, "procedural", texts[d % 6], "trusted", False, False, 10 * (d % 3), "c1", d % 5, None, None) for q, query in enumerate(["the supported way in production", "supported temporary migration", "normally on staging"]) for d in range(8)]
    found = spark.createDataFrame(rows, "query_id long, memory_id long, score double, query string, asks_guidance boolean, memory_type string, searchable_text string, trust string, pending boolean, denied boolean, authority long, source_chain string, provenance_rank int, review_scope string, policy_class string")
    ids = lambda df: sorted((r.query_id, r.memory_id) for r in policy.resolve_conflicts(df).select("query_id", "memory_id").collect())
    want = ids(found)
    assert 0 < len(want) < len(rows)
    assert ids(found.withColumn("shows", policy.shows(F.col("searchable_text"))).drop("searchable_text")) == want


@pytest.mark.parametrize("match_all", [False, True])
def test_few_tasks_and_rounds(spark, monkeypatch, request, match_all):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(1, 30, n))
    cores = spark.sparkContext.defaultParallelism
    m = spark.createDataFrame([(k, words(rng.integers(0, 40))) for k in range(300)], "id long, searchable_text string").repartition(3 * cores)
    q = spark.createDataFrame([(k, words(2)) for k in range(40)] + [(99, "w1 nowhere")], "query_id long, query string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5m")  # a file and its opening
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.files.maxPartitionBytes"))
    rows = lambda df: sorted((r.query_id, r.memory_id, round(r.score, 5)) for r in search.top(df, 5).collect())
    want = rows(search.bm25(m, q, match_all))
    monkeypatch.setattr(search, "TASKS", 1)
    best = search.bm25(m, q, match_all, k=5)
    assert best.rdd.getNumPartitions() <= cores
    assert rows(best) == want and (99 in {x[0] for x in want}) != match_all
    # rounds read the same postings: texts are cut once
    made = []
    plain = search.postings
    monkeypatch.setattr(search, "postings", lambda *a: made.append(1) or plain(*a))
    monkeypatch.setattr(search, "MOST_HELD", 60)
    assert rows(search.bm25(m, q, match_all, k=5)) == want and len(made) == 1
