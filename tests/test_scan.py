"""Forward rows scored where they are read find what the postings find."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_boolean import QUERIES, plain

from tidepool.operators import boolean, inverted, search


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    return [(k, " ".join(f"w{int(x)}" for x in rng.integers(1, 14, rng.integers(0, 25)))) for k in range(120)] + [(900, None), (901, "w1 w2 a well w1 And")]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    made = inverted.Index(spark, str(tmp_path_factory.mktemp("scan") / "index"))
    made.append(spark.createDataFrame(texts[:70], "id long, searchable_text string"))
    made.append(spark.createDataFrame(texts[70:], "id long, searchable_text string"))
    made.delete(spark.createDataFrame([(3,), (80,)], "id long"))
    return made


def test_expressions(spark, texts, index, monkeypatch):
    # many queries together are no join of their leaves with the postings, whose rows grow with queries times memories
    left = [r for r in texts if r[0] not in (3, 80)]
    asked = spark.createDataFrame(list(enumerate(QUERIES * 3)), "query_id long, query string")
    monkeypatch.setattr(boolean, "places", lambda *_: pytest.fail("joined"))
    got = {}
    for r in sorted(boolean.search(index, asked, 9).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.memory_id, r.score))
    for n, q in enumerate(QUERIES * 3):
        want = plain(left, q, 9)
        assert [i for i, _ in got.get(n, [])] == [i for i, _ in want], q
        assert [s for _, s in got.get(n, [])] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("match_all", [False, True])
@pytest.mark.parametrize("most", [200_000, 9])
def test_words(spark, texts, index, monkeypatch, match_all, most):
    monkeypatch.setattr(inverted, "MOST_TERMS", most)
    asked = spark.createDataFrame([(k, f"w{k % 14} w{k * 5 % 13} w{k % 3}") for k in range(20)] + [(77, "none"), (78, "")], "query_id long, query string")
    left = spark.createDataFrame([r for r in texts if r[0] not in (3, 80)], "id long, searchable_text string")
    want = search.top(search.bm25(left, asked, match_all=match_all), 4)
    rows = lambda df: sorted((r.query_id, r["rank"], r.memory_id, round(r.score, 5)) for r in df.collect())
    found = rows(inverted.top_k(index, asked, 4, match_all))
    assert found and found == rows(want)
    monkeypatch.setattr(inverted, "SCANNED", 1e9)
    assert found == rows(inverted.top_k(index, asked, 4, match_all))


def test_compacted(spark, index, tmp_path):
    new = index.compact(str(tmp_path / "new"))
    ids = lambda name: sorted(r[0] for r in new.table(name).select("memory_id").collect())
    assert ids("forward") == ids("docs") and 3 not in ids("docs")


def test_few_tasks_score_many_files(spark, texts, tmp_path, monkeypatch, request):
    # each task writes its k best rows of each query, so these grew with queries times files
    cores = spark.sparkContext.defaultParallelism
    made = inverted.Index(spark, str(tmp_path / "many"))
    made.append(spark.createDataFrame(texts, "id long, searchable_text string").repartition(3 * cores))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5m")  # a file and its opening
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.files.maxPartitionBytes"))
    assert made.table("forward").rdd.getNumPartitions() > cores
    monkeypatch.setattr(inverted, "TASKS", 1)
    leaves = spark.createDataFrame([(1, 1, "word", ["w1"], None), (1, 2, "word", ["w2"], None)], "query_id long, leaf int, kind string, words array<string>, tree string")
    assert inverted.scan(made, leaves, 3, *made.stats()).rdd.getNumPartitions() <= cores


def test_blocks_cut_by_tasks(spark, index):
    forward = index.table("forward")
    assert "sums" not in forward.columns and forward.schema["line"].dataType.elementType.typeName() == "integer"
    want = {(r.block, r.term): (r.n, r.most, r.least) for r in index.table("postings").groupBy("block", "term").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most"), F.min("size").alias("least")).collect()}
    cut = inverted.blocks_of(forward.repartition(5))
    assert cut.count() > len(want)
    assert {(r.block, r.term): (r.n, r.most, r.least) for r in inverted.of_blocks(cut).collect()} == want
    assert {(r.block, r.term): (r.n, r.most, r.least) for r in index.table("blocks").collect()} == want
