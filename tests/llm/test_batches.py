"""How much of the texts a Python process holds at once."""

import corpus_pipeline

from tidepool.llm import packing, sequences


def test_the_pipeline_hands_out_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b' AS text")
    before = spark.conf.get(name)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    try:
        spark.conf.set(name, 10_000)
        corpus_pipeline.packed(spark, docs.limit(3), "")
        assert max(r[0] for r in docs.repartition(1).mapInArrow(sizes, "n long").collect()) <= 1000
        spark.conf.set(name, 7)
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)


def test_slices_lose_nothing(spark):
    docs = spark.range(700).selectExpr("id AS doc_id", "repeat('w x ', cast(id % 9 AS int)) AS text").repartition(1)
    assert sequences.AT_ONCE < 700 and sorted(r.doc_id for r in packing.pack(docs).select("doc_id").distinct().collect()) == list(range(700))
