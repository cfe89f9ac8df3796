"""What reflected knowledge rests on: edges from written objects to the rows that support them, kept in step with writing and retiring, and reflection of the keys alone
that new rows touch. The rows of an object are edges and never a list, as a key may have any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import lifecycle, reflections
from tidepool.operators.reflections import normal

VALIDATED, SUPERSEDED = "validated_by", "superseded_by"


def _key(df: DataFrame) -> DataFrame:
    return df.withColumns({"_key": normal(F.col("knowledge_key")), "_summary": normal(F.col("summary"))})


def supports(objects: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """source_id (the written object), target_id (a row of its key and summary), relation. rows: id, knowledge_key, summary; rows without key or summary support nothing."""
    own = _key(reflections.written(objects, now)).select(F.col("memory_id").alias("source_id"), "_key", "_summary")
    return _key(rows).select(F.col("id").alias("target_id"), "_key", "_summary").join(own, ["_key", "_summary"]).select("source_id", "target_id", F.lit(VALIDATED).alias("relation")).distinct()


def edges_after(edges: DataFrame, objects: DataFrame, persisted: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The edges (source_id, target_id, relation) after objects were written and persisted is what all written rows have become: an object that was written loses what it rested
    on and what superseded it, and rests on its rows of now; one that was retired rests on nothing; superseded ones keep their rows and lead to what replaced
    them. All other edges stay."""
    renewed = reflections.written(objects, now).select(F.col("memory_id").alias("source_id"), F.lit(True).alias("_renewed"))
    retired = persisted.where("status = 'retired'").select(F.col("memory_id").alias("source_id"), F.lit(True).alias("_retired")).distinct()
    both = edges.select("source_id", "target_id", "relation").join(renewed, "source_id", "left").join(retired, "source_id", "left")
    gone = (F.col("_renewed").isNotNull() & F.col("relation").isin(VALIDATED, SUPERSEDED)) | (F.col("_retired").isNotNull() & (F.col("relation") == VALIDATED))
    kept = both.where(~gone).select("source_id", "target_id", "relation")
    return kept.unionByName(supports(objects, rows, now)).unionByName(reflections.superseding_edges(persisted)).distinct()


def touched(*changes: DataFrame) -> DataFrame:
    """The keys of rows that came, went or changed (before and after). changes: with knowledge_key."""
    out = changes[0].select("knowledge_key")
    for more in changes[1:]:
        out = out.unionByName(more.select("knowledge_key"))
    return out.where("knowledge_key IS NOT NULL").distinct()


def reflect_again(objects: DataFrame, rows: DataFrame, keys: DataFrame, **limits: int) -> DataFrame:
    """The objects after some keys' rows have changed: those of other keys as they were, those of keys (touched()) from their rows of now. The same as reflection of all
    rows, but only the rows of these keys are grouped. rows and limits: those of lifecycle.reflect()."""
    again = lifecycle.reflect(rows.join(keys, "knowledge_key", "left_semi"), **limits)
    return objects.join(keys, "knowledge_key", "left_anti").unionByName(again.select(objects.columns))
