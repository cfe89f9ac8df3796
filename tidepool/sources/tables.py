"""The engine's tables over a folder of Parquet files: memories, vectors, relations, access log, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY_TYPES = ("episodic", "semantic", "procedural")
SCHEMA_VERSION = 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories; what documents lack follows from doc_id."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("searchable_text"),
        F.element_at(F.lit(list(MEMORY_TYPES)), (F.col("doc_id") % 3 + 1).cast("int")).alias("memory_type"),
        (F.col("doc_id") % 10 + 1).cast("int").alias("importance"),
        F.col("lang").alias("category"),
        (F.col("doc_id") % 3).cast("int").alias("tier"),
        F.expr("timestampadd(HOUR, CAST(doc_id % 2000 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
        F.expr("CASE WHEN doc_id % 5 = 1 THEN timestampadd(DAY, CAST(doc_id % 60 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') END").alias("valid_from"),
        F.expr("CASE WHEN doc_id % 7 = 2 THEN timestampadd(DAY, CAST(doc_id % 60 + 10 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') END").alias("valid_until"),
        F.expr("element_at(array('trusted','low','untrusted','normal','Maintainer ','weak','external'), CAST(doc_id % 7 + 1 AS INT))").alias("source_trust"),
        F.expr("element_at(array('system','maintainer-note','project_doc','observed-local','user-note','chat-copy','forum-post','web','other'), CAST(doc_id % 9 + 1 AS INT))").alias("source_kind"),
        F.expr("element_at(array('verified','observed','partial','declared','second_hand','copied','unverified','none'), CAST(doc_id % 8 + 1 AS INT))").alias("source_verification"),
        F.col("source").alias("session"),
    )


#: The same table for a SQL engine with views of the Parquet files.
MEMORIES_SQL = """
SELECT doc_id AS id, text AS searchable_text, ['episodic','semantic','procedural'][CAST(doc_id % 3 + 1 AS INT)] AS memory_type,
  CAST(doc_id % 10 + 1 AS INT) AS importance, lang AS category, CAST(doc_id % 3 AS INT) AS tier,
  TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 2000 AS INT)) AS created_at,
  CASE WHEN doc_id % 5 = 1 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INT)) END AS valid_from,
  CASE WHEN doc_id % 7 = 2 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 + 10 AS INT)) END AS valid_until,
  ['trusted','low','untrusted','normal','Maintainer ','weak','external'][CAST(doc_id % 7 + 1 AS INT)] AS source_trust,
  ['system','maintainer-note','project_doc','observed-local','user-note','chat-copy','forum-post','web','other'][CAST(doc_id % 9 + 1 AS INT)] AS source_kind,
  ['verified','observed','partial','declared','second_hand','copied','unverified','none'][CAST(doc_id % 8 + 1 AS INT)] AS source_verification,
  source AS session
FROM documents"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between memories, from doc_id alone."""
    ids = read(spark, sf_dir, "documents").select("doc_id")
    kinds = [("superseded_by", 6, 3, 0.9), ("related_to", 4, 1, 0.8), ("conflicts_with", 9, 2, 0.7), ("depends_on", 10, 5, 0.6), ("caused_by", 14, 4, 0.5)]
    known = F.array(*[F.when(F.col("doc_id") % m == 0, F.struct(F.lit(k).alias("relation"), F.lit(step).cast("long").alias("step"), F.lit(c).alias("confidence"))) for k, m, step, c in kinds])
    edges = ids.select("doc_id", F.explode(F.array_compact(known)).alias("e")).select(F.col("doc_id").alias("source_id"), (F.col("doc_id") + F.col("e.step")).alias("target_id"), "e.relation", "e.confidence")
    return edges.join(ids.select(F.col("doc_id").alias("target_id")), "target_id", "left_semi").select(
        "source_id", "target_id", "relation", "confidence", F.expr("CASE WHEN source_id % 8 = 0 THEN TIMESTAMP_NTZ'2024-02-01 00:00:00' END").alias("valid_until")
    )


RELATIONS_SQL = """
SELECT doc_id AS source_id, doc_id + step AS target_id, relation, confidence,
  CASE WHEN doc_id % 8 = 0 THEN TIMESTAMP '2024-02-01' END AS valid_until
FROM documents, (VALUES ('superseded_by', 6, 3, CAST(0.9 AS DOUBLE)), ('related_to', 4, 1, 0.8), ('conflicts_with', 9, 2, 0.7), ('depends_on', 10, 5, 0.6), ('caused_by', 14, 4, 0.5)) k(relation, m, step, confidence)
WHERE doc_id % m = 0 AND doc_id + step IN (SELECT doc_id FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding", F.concat(F.lit("model-"), (F.col("label") % 2).cast("string")).alias("model_name"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), F.col("ts").alias("accessed_at"), F.col("event_type").alias("query_text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
