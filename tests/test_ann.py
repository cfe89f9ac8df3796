"""Approximate search against exact search."""

import numpy as np

from tidepool.operators import ann, search
from tidepool.sources import tables

SF = "/root/testdata/sf0.001"


def pairs(df):
    return {(r.query_id, r.memory_id): r.score for r in df.collect()}


def test_all_lists_are_exact(spark):
    v = tables.vectors(spark, SF)
    asked = v.where("memory_id % 20 = 0").selectExpr("memory_id AS query_id", "embedding")
    centres = ann.train(v, 16)
    index = ann.build(v, centres)
    want = pairs(search.vector_topk(v, asked, 10))
    assert index.count() == v.count()
    assert pairs(ann.search(index, centres, asked, 10, 16)) == want
    some = pairs(ann.search(index, centres, asked, 10, 12))  # random vectors: the least favourable case
    assert len(some.keys() & want.keys()) >= 0.9 * len(want)


def test_grouped_vectors_need_few_lists(spark, tmp_path):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(20, 16))
    data = middles[np.arange(2000) % 20] + 0.1 * rng.normal(size=(2000, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(data)], "memory_id long, embedding array<double>")
    asked = v.where("memory_id % 100 = 0").selectExpr("memory_id AS query_id", "embedding")
    centres = ann.train(v, 20)
    ann.build(v, centres).write.partitionBy("list").parquet(f"{tmp_path}/index")
    found = pairs(ann.search(spark.read.parquet(f"{tmp_path}/index"), centres, asked, 10, 4))
    want = pairs(search.vector_topk(v, asked, 10))
    assert len(found.keys() & want.keys()) >= 0.9 * len(want)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "memory_id long, embedding array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "memory_id long, embedding array<double>")
    asked = v.selectExpr("memory_id AS query_id", "embedding")
    assert ann.search(ann.build(none, ann.train(none, 4)), ann.train(none, 4), asked, 3, 2).count() == 0
    centres = ann.train(v, 4)
    assert pairs(ann.search(ann.build(v, centres), centres, asked, 3, 2)) == {(1, 1): 1.0}
    assert ann.search(ann.build(v, centres), centres, asked.where("false"), 3, 2).count() == 0
