"""The lasting index against search over the texts: after writes, appends, deletions, replacements and compaction."""

import numpy as np
import pytest

from tidepool.operators import inverted, search

ROWS = "id long, searchable_text string"
ASK = "query_id long, query string"


def words(rng, n):
    """Few frequent words and many rare ones."""
    return " ".join(f"w{int(k)}" for k in rng.zipf(1.3, n) if k < 5000)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    return [(k, words(rng, int(rng.integers(1, 60)))) for k in range(600)] + [(9000, None), (9001, ""), (9002, "W1, w2! W1")]


def same(spark, index, memories, asked, k=5):
    for match_all in (False, True):
        got = sorted((r.query_id, r["rank"], r.memory_id, r.score) for r in inverted.top_k(index, asked, k, match_all).collect())
        want = sorted((r.query_id, r["rank"], r.memory_id, r.score) for r in search.top(search.bm25(memories, asked, match_all), k).collect())
        assert got == want and got


def test_index_through_its_life(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 16)
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(["w1 w2", "w7 w30 w2", "w900", "the w3", "w4 w1 w12 w40", "nothing here", ""])] + [(-3, None)], ASK)
    frame = lambda rows: spark.createDataFrame(rows, ROWS).repartition(3)
    index = inverted.Index(spark, str(tmp_path / "index"))
    assert inverted.top_k(index, asked, 3).count() == 0  # nothing was written yet
    index.append(frame(texts[:400]))
    same(spark, index, frame(texts[:400]), asked)
    index.append(frame(texts[400:]))
    same(spark, index, frame(texts), asked)
    gone = {k for k, _ in texts if k % 3 == 0}
    index.delete(spark.createDataFrame([(k,) for k in gone] + [(77777,)], "id long"))
    left = [t for t in texts if t[0] not in gone]
    same(spark, index, frame(left), asked)
    changed = [(left[0][0], "w900 w900 new"), (left[1][0], "w2")]
    index.replace(frame(changed))
    final = changed + left[2:]
    same(spark, index, frame(final), asked)
    small = index.compact(str(tmp_path / "small"))
    same(spark, small, frame(final), asked)
    assert small.table("postings").count() < index.table("postings").count() and small.table("gone").count() == 0


def test_blocks_are_skipped(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    index = inverted.Index(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame(texts, ROWS).repartition(2))
    asked = spark.createDataFrame([(1, "w1 w250"), (2, "w2 w99 w31")], ASK)
    held, read = inverted.blocks_read(index, asked, 3)
    assert 0 < read < 0.7 * held
