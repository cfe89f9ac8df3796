"""Facts stored with their edges, the substring join, reviews that keep what they say, and counts of a stream over several batches."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tidepool.operators import extraction, ingest, review
from tidepool.streaming import access

NOW = "TIMESTAMP_NTZ'2024-03-01 00:00:00'"


def test_substrings_by_brute_force(spark):
    rng = np.random.default_rng(2)
    make = lambda n: "".join("abc é"[int(k)] for k in rng.integers(0, 5, n))
    texts = [(k, make(int(rng.integers(0, 60)))) for k in range(150)] + [(900, None), (901, ""), (902, "abc" * 3000)]
    needles = sorted({make(int(n)) for n in rng.integers(1, 9, 60)} | {"zzzzz", "a"})
    df = spark.createDataFrame(texts, "id long, low string").repartition(3)
    asked = spark.createDataFrame([(n,) for n in needles] + [(None,), ("",)], "needle string")
    got = sorted((r.needle, r.id) for r in extraction.containing(df, asked).collect())
    assert got == sorted((n, i) for n in needles for i, t in texts if t and n in t)
    assert extraction.containing(df, asked.where("needle = ''")).count() == 0


def test_both_parts_in_older_texts_by_brute_force(spark):
    rng = np.random.default_rng(3)
    make = lambda n: "".join("abcdé "[int(k)] for k in rng.integers(0, 6, n))
    texts = [(k, make(int(rng.integers(0, 90)))) for k in range(200)] + [(900, None), (901, ""), (902, "abcdabcdab" * 20_000)]
    asked = sorted({(int(rng.integers(0, 950)), make(int(rng.integers(1, 12))), make(int(rng.integers(0, 4)))) for _ in range(300)})
    df = spark.createDataFrame(texts, "id long, low string").repartition(3)
    rows = spark.createDataFrame([*asked, (999, None, "a"), (999, "a", None), (999, "", "a")], "target_id long, needle string, relation string")
    want = sorted((i, t) for t, needle, relation in asked for i, low in texts if low is not None and i < t and needle in low and relation in low)
    for most in (200_000, 70):
        extraction.MOST_ASKED, kept = most, extraction.MOST_ASKED
        try:
            assert sorted(tuple(r) for r in extraction.older_holding(df, rows).collect()) == want
        finally:
            extraction.MOST_ASKED = kept


def test_facts_are_stored_once_and_supersede(spark):
    memories = spark.createDataFrame([(1, "The Relay lives in Oslo"), (2, "Nothing"), (7, "relay, it lives   in Rome"), (9, None)], "id long, searchable_text string")
    answers = [
        (5, "fact|8|Relay lives in Bergen|Relay|Relay>lives_in>Bergen\nfact|3|Nothing||\nfact|5|Bob owns a cat|Bob|Bob>owns>cat;>x>y"),
        (6, "fact|8|Relay lives in Bergen|Relay|Relay>lives_in>Bergen\nfact|200|Bob owns a dog||Bob>owns>dog\nno"),
    ]
    facts = ingest.parse_facts(spark.createDataFrame(answers, "id long, answer string"))
    rows, edges, counts = extraction.store_facts(memories, facts, F.expr(NOW))
    ids = {r.searchable_text: r.id for r in rows.collect()}
    assert ids == {"Relay lives in Bergen": 10, "Bob owns a cat": 11, "Bob owns a dog": 12}
    assert sorted((r.source_id, r.target_id, r.relation) for r in edges.collect()) == [(1, 10, "superseded_by"), (11, 12, "superseded_by")]
    assert tuple(counts.select("facts_extracted", "memories_stored", "duplicates_skipped", "edges_created").first()) == (5, 3, 2, 2)
    none = extraction.store_facts(memories, facts.where("false"), F.expr(NOW))
    assert [x.count() for x in none] == [0, 0, 1]
    empty = extraction.store_facts(memories.where("false"), facts, F.expr(NOW))
    assert sorted(r.id for r in empty[0].collect()) == [1, 2, 3, 4]


ITEMS = "id long, review_required boolean, review_status string, review_expires_at timestamp_ntz, review_note string, created_at timestamp_ntz, review_scope string, review_policy_class string, review_template string, reviewer string"


def test_decisions_keep_what_items_say(spark):
    day = datetime(2024, 2, 1)
    items = spark.createDataFrame([(k, True, "pending", None, None, day, "lab", "auth-bypass-exception", "lab-auth-bypass", "ann") for k in (1, 2, 3)], ITEMS)
    asked = spark.createDataFrame([(1, "again", datetime(2024, 4, 1))], "id long, note string, expires_at timestamp_ntz")
    got = {r.id: r for r in review.resolve(items, review.renewed(asked, items), F.expr(NOW)).collect()}
    assert (got[1].review_status, got[1].review_scope, got[1].review_policy_class, got[1].review_template, got[1].reviewer) == ("allowed", "lab", "auth-bypass-exception", "lab-auth-bypass", "ann")
    said = spark.createDataFrame([(2, "allowed", "migration-bridge", "bob")], "id long, status string, template string, reviewer string").selectExpr("*", "CAST(NULL AS TIMESTAMP_NTZ) expires_at", "CAST(NULL AS STRING) note")
    got = {r.id: r for r in review.resolve(items, said, F.expr(NOW)).collect()}
    assert (got[2].review_scope, got[2].review_policy_class, got[2].reviewer, got[2].review_expires_at) == ("migration", "migration-exception", "bob", datetime(2024, 3, 8))
    assert (got[3].review_status, got[3].reviewer) == ("pending", "ann")
    changes = spark.createDataFrame([(1, "denied"), (3, "allowed"), (77, "denied")], "id long, status string")
    got = {r.id: (r.review_status, r.review_required, r.reviewer) for r in review.with_status(items, changes).collect()}
    assert got == {1: ("denied", True, "ann"), 2: ("pending", True, "ann"), 3: ("allowed", True, "ann")}
    one = review.item(items, spark.createDataFrame([(2,), (88,)], "id long"), F.expr(NOW)).collect()
    assert [(r.id, r.effective_status) for r in one] == [(2, "pending")]


def test_counts_of_a_stream_in_several_batches(spark, tmp_path):
    schema = "user_id long, ts timestamp_ntz, event_type string, event_id long"
    rows = [(k % 3, datetime(2024, 1, 1 + k % 4, k % 24), "x", k) for k in range(200)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for at in (0, 80, 140):
        spark.createDataFrame(rows[at : at + (80 if at == 0 else 60)], schema).coalesce(1).write.mode("append").parquet(path)
        stream = access.access_stream(spark, path, schema, "*.parquet")
        access.kept_counts(stream, out, late="10 days").awaitTermination()
    got = {(r.day.day, r.memory_id): r.n for r in access.read_counts(spark, out).collect()}
    want = {}
    for user, ts, _, _ in rows:
        want[ts.day, user] = want.get((ts.day, user), 0) + 1
    assert got == want
    twice = spark.readStream.schema(schema).parquet(path).select("event_id", F.col("ts").cast("timestamp").alias("accessed_at"))
    both = twice.union(twice)
    assert access.without_repeats(both, "event_id").isStreaming
