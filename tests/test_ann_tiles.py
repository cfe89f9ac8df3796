"""A batch of vectors is multiplied with a tile of queries at a time."""

import numpy as np

from tidepool.operators import ann, search


def test_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 4)]) for k in range(300)]
    vectors = spark.createDataFrame(rows, "memory_id long, embedding array<double>")
    asked = vectors.selectExpr("memory_id AS query_id", "embedding")
    sizes, made = [], np.round
    monkeypatch.setattr(ann, "TILE", 7, raising=False)
    monkeypatch.setattr(ann, "CELLS", 70, raising=False)
    centres = ann.train(vectors, 5)
    out = lambda df: sorted((r.query_id, r["rank"], r.memory_id, r.score) for r in df.collect())
    assert out(ann.search(ann.build(vectors, centres), centres, asked, 3, 5)) == out(search.vector_topk(vectors, asked, 3))

    # the task itself: no product has more than CELLS numbers
    monkeypatch.setattr(ann.np, "round", lambda x, n: sizes.append(x.size) or made(x, n))
    kept = []
    monkeypatch.setattr(ann, "top", lambda df, k: df)

    class Read:
        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, run, schema):  # noqa: N802
            kept.append(run)

    ann._search(Read(), centres, asked, 3, 5)
    list(kept[0](iter(ann.build(vectors, centres).toArrow().to_batches())))
    assert sizes and max(sizes) <= 70
