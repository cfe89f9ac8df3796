"""Reflection, reviews, embeddings and ingest on small rows, worked by hand."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepool.functions import embedding as em
from tidepool.functions import text as tx
from tidepool.operators import ingest, reflections, review


def at(when):
    return F.expr(f"TIMESTAMP_NTZ'{when}'")


OBJECT = "knowledge_key string, summary string, support long, trusted long, authoritative long, authority long, provenance long, confidence string, contested boolean, unresolved boolean, rival_summary string, rival_support long, rival_trusted long"


def objects(spark, *rows):
    return spark.createDataFrame([(k, s, n, n, 0, 10 * n, 5, "high", False, tie, None, 0, 0) for k, s, n, tie in rows], OBJECT)


def test_summary_and_key(spark):
    rows = [("Relay node: It listens on port eighty. Then more", None), ("One two three four five: kept", None), ("  \n ", None), ("Short. Next", None), ("x", " given "), ("a:b:c", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, g string")
    assert [r[0] for r in df.select(reflections.summary(F.col("t"), F.col("g"))).collect()] == ["It listens on port eighty", "One two three four five: kept", None, "Short. Next", "given", "b:c", None]
    keys = [r[0] for r in df.select(reflections.knowledge_key(F.col("t"), F.col("g"))).collect()]
    assert keys == ["relay-node-it-listens", "one-two-three-four", None, "short-next", "given", "a-b-c", None]


def test_writing_again_supersedes_and_retires(spark):
    none = reflections.written(objects(spark).limit(0), at("2024-03-01 00:00:00"))
    first = reflections.persist(objects(spark, ("Key A", "old", 2, False), ("b", "same", 2, True), ("c", "gone", 2, False)), none, at("2024-03-01 00:00:00"))
    assert {(r.knowledge_key, r.status) for r in first.collect()} == {("Key A", "current"), ("b", "contested"), ("c", "current")}
    fresh = objects(spark, ("key a", "new", 3, False), ("b", "Same!", 3, False))
    later = at("2024-03-01 01:00:00")
    plan = reflections.refresh_plan(fresh, first, later)
    told = {r.knowledge_key: (r.action, r.reasons) for r in plan.collect()}
    assert told == {"key a": ("persist", "summary-changed,support-growth,trusted-support-growth,authority-strengthened"), "b": ("persist", "support-growth,trusted-support-growth,authority-strengthened"), "c": ("retire", "no-longer-qualifies")}
    out = reflections.refresh(plan, fresh, first, later)
    rows = {(r.knowledge_key, r.summary): r for r in out.collect()}
    assert {k: r.status for k, r in rows.items()} == {("Key A", "old"): "superseded", ("key a", "new"): "current", ("b", "Same!"): "current", ("c", "gone"): "retired"}
    assert rows["Key A", "old"].replaced_by == rows["key a", "new"].memory_id and rows["c", "gone"].valid_until is not None
    assert [(r.source_id, r.target_id) for r in reflections.superseding_edges(out).collect()] == [(rows["Key A", "old"].memory_id, rows["key a", "new"].memory_id)]
    assert reflections.refresh_plan(fresh, out, later).count() == 0
    stale = reflections.refresh_plan(fresh, out, at("2024-03-02 01:00:00"))
    assert {r.reasons for r in stale.collect()} == {"stale-by-age"}
    assert reflections.refresh_plan(fresh, out, at("2024-04-02 01:00:00"), None).count() == 0


def test_large_texts_are_cut_at_line_ends_or_characters(spark):
    texts = ["", "a" * 6000, "a" * 6001, "line\n" * 3000, "é" * 5000, None, "x" + "日" * 4000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ingest.split_large("t")).collect()]
    for t, parts in zip(texts, got, strict=True):
        if t is None:
            assert parts is None
        else:
            assert "".join(parts) == t and all(0 < len(p.encode()) <= 6000 for p in parts)
    assert all(p.endswith("\n") for p in got[3]) and len(got[2]) == 2


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1e-9, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(em.unit(F.col("v"))).collect()]
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] == [0.0, 0.0] and got[2] is None and got[3][0] < 1e-8
    assert bytes(df.select(em.to_bytes("v")).first()[0]) == np.array([3, 4], "<f4").tobytes()
    assert em.from_bytes.func(pd.Series([np.array([1, 2], "<f4").tobytes() + b"x"]))[0].tolist() == [1, 2]
    rows = spark.createDataFrame([(1, "text"), (2, "  "), (3, None)], "id long, searchable_text string")
    assert [(r.id, r.embedding) for r in em.embed(rows, em.NoModel(3)).collect()] == [(1, [0.0, 0.0, 0.0])]
    names = spark.createDataFrame([("all-MiniLM-L6-v2",), ("x",)], "n string")
    assert [tuple(r) for r in names.select(em.canonical_model(F.col("n")), em.model_profile(F.col("n"), F.lit(384))).collect()] == [("local-minilm", em.LOCAL_PROFILE), ("x", "custom|x|384")]


def test_annotation_keeps_what_is_there(spark):
    rows = [(1, "procedural", "skip auth", None, {"review_status": "denied"}), (2, "semantic", "plain", None, None), (3, "semantic", "plain", None, {"review_status": "allowed"})]
    df = spark.createDataFrame(rows, "id long, memory_type string, searchable_text string, content_sensitivity string, metadata map<string,string>")
    got = {r.id: r.metadata for r in review.annotate(df).collect()}
    assert got[1]["review_status"] == "denied" and got[1]["review_severity"] == "critical" and got[1]["review_required"] == "true"
    assert got[2] is None and got[3] == {"review_status": "allowed", "review_required": "true"}


def test_dated_and_passthrough(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", ""), (3, "c", None)], "id long, text string, d string")
    assert [r[0] for r in df.select(tx.dated(F.col("text"), F.col("d"))).collect()] == ["[Date: 2024-01-01] a", "b", "c"]
    assert tuple(ingest.passthrough(df).first()) == (1, "a", None, "episodic", 5)
