"""Storing as one step, and rows of earlier schemas."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import store

NEW = "id long, searchable_text string, memory_type string, content_sensitivity string, metadata map<string,string>, note string"


def test_storing_annotates_dedups_and_embeds(spark):
    existing = spark.createDataFrame([(1, "known text")], "id long, searchable_text string")
    rows = [(10, "known text", "semantic", None, None, "x"), (11, "disable auth on the relay", "procedural", None, {"a": "b"}, "x"), (12, "fresh", "semantic", None, None, "x"), (13, "fresh", "semantic", None, None, "x"), (14, None, "semantic", None, None, "x"), (15, "  ", "semantic", None, None, "x"), (16, "fails", "semantic", None, None, "x")]
    new = spark.createDataFrame(rows, NEW)
    embed = lambda t: t.where("text <> 'fails'").select("id", F.array(F.length("text").cast("double")).alias("embedding"))
    added, vectors, outcome = store.store(existing, new, embed, "m")
    got = {r.id: r for r in added.collect()}
    assert {k: r.embedding_status for k, r in got.items()} == {11: "success", 12: "success", 14: "pending", 15: "pending", 16: "failed"}
    assert got[11].metadata["review_status"] == "pending" and got[11].metadata["a"] == "b" and got[12].metadata is None and got[12].note == "x"
    assert {r.memory_id: (r.embedding, r.model_name) for r in vectors.collect()} == {11: ([25.0], "m"), 12: ([5.0], "m")}
    assert {r.id: (r.outcome, r.stored_id) for r in outcome.collect()} == {10: ("duplicate", 1), 11: ("added", 11), 12: ("added", 12), 13: ("duplicate", 12), 14: ("added", 14), 15: ("added", 15), 16: ("added", 16)}
    plain, none, _ = store.store(existing, new, dedup=False)
    assert plain.count() == 7 and none.count() == 0 and {r.embedding_status for r in plain.collect()} == {"pending"}
    assert store.store(existing, new.limit(0), embed)[0].count() == 0


def test_earlier_schemas(spark):
    old = spark.createDataFrame([(1, "a text")], "id long, searchable_text string")
    r = store.migrate(old).first()
    assert (r.schema_version, r.embedding_status, r.metadata) == (1, "pending", None) and len(r.content_hash) == 64
    kept = store.migrate(old.withColumn("content_hash", F.lit("own"))).first()
    assert kept.content_hash == "own"
    with pytest.raises(Exception, match="later schema"):
        store.migrate(old.withColumn("schema_version", F.lit(99))).collect()
