"""Reflection in increments against reflection of everything, and the edges that go with it."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tidepool.operators import lifecycle, lineage, reflections

NOW = "TIMESTAMP_NTZ'2024-03-01 00:00:00'"
ROWS = "id long, knowledge_key string, summary string, trusted boolean, authority long, provenance long, created_at timestamp_ntz"


def test_increments_equal_the_whole(spark):
    rng = np.random.default_rng(6)
    rows, number = {}, 0
    frame = lambda d: spark.createDataFrame(list(d.values()), ROWS)
    objects = lifecycle.reflect(frame({}))
    for _ in range(3):
        before = dict(rows)
        came = {}
        for _ in range(25):
            number += 1
            came[number] = (number, f"k{rng.integers(12)}", f"s{rng.integers(3)}", bool(rng.random() < 0.6), int(rng.choice([0, 55, 100])), int(rng.integers(9)), datetime(2024, 1, 1 + number % 28))
        went = {k: before[k] for k in before if rng.random() < 0.2}
        rows = {k: v for k, v in (before | came).items() if k not in went}
        keys = lineage.touched(frame(came), frame(went))
        objects = spark.createDataFrame(lineage.reflect_again(objects, frame(rows), keys).collect(), objects.schema)
        whole = lifecycle.reflect(frame(rows))
        assert sorted(map(tuple, objects.select(whole.columns).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert objects.count() > 5


def test_edges_follow_writing_and_retiring(spark):
    now = F.expr(NOW)
    row = lambda i, s, trusted=True: (i, "Key One", s, trusted, 0, 1, datetime(2024, 1, i))
    first = spark.createDataFrame([row(1, "Old way"), row(2, "old  way"), row(3, "old way"), row(4, "new way")], ROWS).withColumn("summary", reflections.normal(F.col("summary")))
    objects = lifecycle.reflect(first)
    persisted = reflections.persist(objects, reflections.written(objects.where("false"), now), now)
    none = spark.createDataFrame([(77, 78, "related_to")], "source_id long, target_id long, relation string")
    edges = lineage.edges_after(none, objects, persisted, first, now)
    old = persisted.first().memory_id
    assert {tuple(r) for r in edges.collect()} == {(77, 78, "related_to"), *[(old, k, "validated_by") for k in (1, 2, 3)]}

    more = first.unionByName(spark.createDataFrame([row(k, "new way") for k in (5, 6, 7, 8)], ROWS))
    objects = lifecycle.reflect(more)
    persisted = reflections.persist(objects, persisted, now)
    new = objects.select(F.xxhash64(reflections.normal(F.col("knowledge_key")), reflections.normal(F.col("summary")))).first()[0]
    edges = lineage.edges_after(edges, objects, persisted, more, now)
    assert {tuple(r) for r in edges.collect()} == {(77, 78, "related_to"), (old, new, "superseded_by"), *[(old, k, "validated_by") for k in (1, 2, 3)], *[(new, k, "validated_by") for k in (4, 5, 6, 7, 8)]}

    # the old summary comes back: it is superseded no longer, and rests on its rows of now
    back = more.where("id NOT IN (6, 7, 8)").unionByName(spark.createDataFrame([row(k, "old way") for k in (9, 10)], ROWS))
    objects = lifecycle.reflect(back)
    persisted = reflections.persist(objects, persisted, now)
    edges = lineage.edges_after(edges, objects, persisted, back, now)
    got = {tuple(r) for r in edges.collect()}
    assert {(old, k, "validated_by") for k in (1, 2, 3, 9, 10)} <= got and (old, new, "superseded_by") not in got and (new, old, "superseded_by") in got

    persisted = reflections.retire(persisted, spark.createDataFrame([("key one",)], "knowledge_key string"), now)
    edges = lineage.edges_after(edges, objects.where("false"), persisted, back.where("false"), now)
    assert not any(s == old and r == "validated_by" for s, _, r in map(tuple, edges.collect()))
