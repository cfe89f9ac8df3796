"""Search over codes: recall against exact search, stale indexes, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from tidepool.operators import codes, search
from tidepool.sources import tables

SF = "/root/testdata/sf0.1"


def pairs(df):
    return {(r.query_id, r.memory_id): r.score for r in df.collect()}


def test_recall_and_what_is_read(spark, tmp_path):
    """Given vectors, of no groups: nine tenths of the exact result while a query reads 5 % of the vectors, and a code of a sixteenth of their size."""
    v = tables.vectors(spark, SF)
    asked = v.where("memory_id % 20 = 0").selectExpr("memory_id AS query_id", "embedding")
    path = str(tmp_path / "index")
    codes.build(v, path, "m")
    want, got = pairs(search.vector_topk(v, asked, 10)), pairs(codes.search(path, v, asked, 10, "m"))
    shared = want.keys() & got.keys()
    assert len(shared) >= 0.9 * len(want) and all(abs(want[x] - got[x]) < 2e-6 for x in shared)
    read = codes.short_list(spark, path, asked).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert read <= v.count() / 4
    sizes = spark.read.parquet(f"{path}/codes").select(F.max(F.octet_length("code"))).first()[0]
    assert sizes == 16 and spark.read.parquet(f"{path}/codes").count() == v.count()


def test_a_stale_index_is_noticed(spark, tmp_path):
    rng = np.random.default_rng(3)
    frame = lambda rows: spark.createDataFrame([(k, x.tolist()) for k, x in rows], "memory_id long, embedding array<double>")
    data = list(enumerate(rng.normal(size=(60, 6))))
    v, path = frame(data), str(tmp_path / "index")
    asked = frame(data[:5]).withColumnRenamed("memory_id", "query_id")
    assert codes.is_stale(path, v, "a")
    assert pairs(codes.search(path, v, asked, 3, "a")) == pairs(search.vector_topk(v, asked, 3))  # there is none yet
    codes.build(v, path, "a")
    assert not codes.is_stale(path, v, "a") and codes.is_stale(path, v, "b")
    more, moved = frame([*data, (99, 9 * data[0][1])]), frame([*data[:-1], (59, 9 * data[0][1])])
    for other, best in ((more, 99), (moved, 59)):
        assert codes.is_stale(path, other, "a")
        assert max(codes.search(path, other, asked.where("query_id = 0"), 1, "a").collect(), key=lambda r: r.score).memory_id == best
    codes.search(path, more, asked, 3, "a", rebuild=True).count()
    assert not codes.is_stale(path, more, "a") and codes.is_stale(path, v, "a")
    assert pairs(codes.search(path, more, asked, 3, "a", short=61)) == pairs(search.vector_topk(more, asked, 3))  # a short list of all rows is exact


def test_odd_rows(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, None), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.0])], "memory_id long, embedding array<double>")
    path = str(tmp_path / "index")
    codes.build(v, path, "m")
    asked = v.selectExpr("memory_id AS query_id", "embedding")
    assert pairs(codes.search(path, v, asked, 2, "m")) == pairs(search.vector_topk(v, asked, 2))
    none = v.where("false")
    assert codes.search(str(tmp_path / "none"), none, asked, 2, "m", rebuild=True).count() == 0
    codes.build(none, path, "m")
    assert codes.is_stale(path, v, "m") and codes.search(path, v, asked.where("false"), 2, "m").count() == 0
