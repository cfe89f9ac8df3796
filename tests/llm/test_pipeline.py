"""The stages of the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepool.llm import dedup


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(docs, percent):
    """The least id of each id's group of near copies; ids are not null."""
    sets = {k: shingles(t) for k, t in docs}
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if label[a] != label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def copies_of(base, changes):
    """base with so many words replaced, each far from the others."""
    w = base.split()
    for k in range(changes):
        w[20 + 30 * k] = f"other{k}"
    return " ".join(w)


def test_copies_between_80_and_85_go(spark):
    docs = []
    for g in range(12):  # with three of 150 words replaced 131 of 161 shingles are shared: 0.81
        base = " ".join(f"g{g}w{k}" for k in range(150))
        docs += [(3 * g, base), (3 * g + 1, copies_of(base, 3)), (3 * g + 2, " ".join(base.split()[:90] + [f"g{g}x{k}" for k in range(60)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = groups(docs, 80)
    assert {r.doc_id: r.component_id for r in dedup.near_duplicates(df, 80).collect()} == want
    assert want != groups(docs, 85)
    left = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, v in want.items() if k == v)


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_bands_and_sketch_follow_the_threshold(percent):
    p = percent / 100
    bands, rows = dedup.layout(percent)
    assert (1 - p**rows) ** bands <= 3e-6
    bound = dedup.sketch_bound(percent)
    assert 6 <= (160 * p - bound) / np.sqrt(160 * p * (1 - p)) < 7
    if percent == 85:
        assert (bands, rows, bound) == (40, 8, 106)


def prose(name, n):
    return " ".join(f"{name}word{k}" for k in range(n))


def texts_of(rows):
    return sorted((str(r.doc_id), r.text) for r in rows)


@pytest.fixture
def corpus(spark, tmp_path):
    """Documents of one source, so that the mix takes each row once or twice (1.5 times the words); ids are missing and repeated."""
    docs = [(k, prose(f"d{k}", 40 + k)) for k in range(20)]
    docs += [(100, copies_of(prose("base", 150), 0)), (101, copies_of(prose("base", 150), 3)), (102, copies_of(prose("base", 150), 1))]
    docs += [(5, docs[5][1]), (5, docs[5][1])]  # one id thrice
    docs += [(None, prose("n", 90)), (None, prose("m", 91)), (None, prose("o", 92)), (None, prose("n", 90)), (None, docs[7][1])]
    docs += [(7, prose("other", 70)), (300, prose("clash", 80)), (300, prose("clash2", 80))]  # other texts under one id
    docs += [(200, "too short"), (None, "short too"), (None, None)]
    rows = [(k, t, "en", "s", len(t or ""), "x", 1, "y") for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _copies string, size int, component_id string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs


def test_run_keeps_rows_without_and_with_repeated_ids(spark, corpus):
    folder, docs = corpus
    long = [(k, t) for k, t in docs if t and len(t.split()) >= 20]
    label = groups([(n, t) for n, (_, t) in enumerate(long)], corpus_pipeline.PERCENT)
    best = {}
    for n, (k, t) in enumerate(long):
        best.setdefault(label[n], []).append((k is None, k or 0, t))
    want = sorted((str(None if none else k), t) for none, k, t in map(min, best.values()))

    left = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = corpus_pipeline.materialize(stage(spark, left, folder), "tested")
        if name == "quality rules":
            assert texts_of(left.collect()) == sorted((str(k), t) for k, t in long)
        elif name == "near duplicates":
            assert texts_of(left.collect()) == want
    mixed = texts_of(left.collect())
    assert set(mixed) == set(want) and all(want.count(x) <= mixed.count(x) <= 2 * want.count(x) for x in want)
    words = sum(len(t.split()) for _, t in want)
    assert abs(sum(len(t.split()) for _, t in mixed) - 1.5 * words) <= 0.02 * 1.5 * words

    size = {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.packing.pack(left).collect()}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.doc_tokens) for r in packed} == size
    starts = [str(r.doc_id) for r in packed if r.start == 0]
    ids = [k for k, _ in want]
    assert all(ids.count(k) <= starts.count(k) <= 2 * ids.count(k) for k in ids) and set(starts) == set(ids)


def test_mix_without_ids_takes_rows_apart(spark):
    """Equal ids, or none, have copies of their own: their words add up to the target."""
    docs = spark.createDataFrame([(None if k % 2 else 1, prose(f"x{k}", 30 + k), "en", "s", 0) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    words = sum(30 + k for k in range(60))
    found = sum(len(r.text.split()) for r in corpus_pipeline.mixed(spark, docs, "").collect())
    assert abs(found - 1.5 * words) <= 0.01 * words


def test_an_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_open_buckets_lose_no_link(spark, monkeypatch):
    """Blocks of two members, and few stars: links between blocks, inside the others and across to the major component are all found."""
    monkeypatch.setattr(dedup, "BLOCK", 2)
    monkeypatch.setattr(dedup, "STARS", 2)
    rng = np.random.default_rng(5)
    base = prose("b", 60).split()
    docs = []
    for k in range(90):  # a cloud around one text in which most pairs share bands and about half are linked
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 3), replace=False):
            w[at] = f"z{rng.integers(40)}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in dedup.near_duplicates(df, 80).collect()} == groups(docs, 80)


def test_rows_are_numbered_by_place(spark, tmp_path):
    """A table's rows keep their numbers however it is split; what is not whole files is written first."""
    spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text")).repartition(5).write.parquet(f"{tmp_path}/d")

    def numbers():
        rows = corpus_pipeline.numbered(spark.read.parquet(f"{tmp_path}/d"))
        return {r.doc_id: r[corpus_pipeline.ROW] for r in rows.collect()}

    first = numbers()
    assert len(set(first.values())) == 500
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert numbers() == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    docs = spark.read.parquet(f"{tmp_path}/d")
    for other in (docs.where("doc_id % 3 = 0"), docs.unionByName(docs), docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))), spark.createDataFrame([(1, "a"), (1, "a")], docs.schema)):
        rows = corpus_pipeline.numbered(other).select(corpus_pipeline.ROW)
        assert rows.distinct().count() == rows.count() == other.count()
