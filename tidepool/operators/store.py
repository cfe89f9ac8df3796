"""Writing memories as one step: review metadata is filled in, texts that are stored already are left out, the others are embedded, and each row says how that went."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import lifecycle, review
from tidepool.sources.folder import written
from tidepool.sources.tables import SCHEMA_VERSION

Embed = Callable[[DataFrame], DataFrame]


def store(existing: DataFrame, new: DataFrame, embed: Embed | None = None, model_name: str = "", dedup: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that are added, their vectors, and the outcome of each new row (id, outcome, stored_id).

    new: id, searchable_text, memory_type, content_sensitivity, metadata (a map, or null), and whatever else; existing: id, searchable_text. embed: (id, text) to (id,
    embedding); it may leave rows out or give none. Rows added have content_hash, metadata with what review.annotate() finds, schema_version, and embedding_status: success with a
    vector; failed where embed gave none; pending where there was no text or nothing to embed with. vectors: memory_id, embedding, model_name, content_hash. Without
    dedup all rows are added."""
    found = lifecycle.store(existing, new) if dedup else new.select("id", tx.content_hash(F.col("searchable_text")).alias("content_hash"), F.lit("added").alias("outcome"), F.col("id").alias("stored_id"))
    outcome = written(found, "outcome")
    nothing = new.where("searchable_text IS NULL").select("id", F.lit(None).cast("string").alias("content_hash"), F.lit("added").alias("outcome"), F.col("id").alias("stored_id"))
    outcome = outcome.unionByName(nothing) if dedup else outcome
    added = new.join(outcome.where("outcome = 'added'").select("id", "content_hash"), "id")
    rows = review.annotate(added).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    text = F.col("searchable_text")
    wanted = added.where(F.length(F.trim(text)) > 0).select("id", tx.for_embedding(text).alias("text"), "content_hash")
    if embed is None:
        vectors = wanted.select(F.col("id").alias("memory_id"), F.array().cast("array<double>").alias("embedding"), F.lit(model_name).alias("model_name"), "content_hash").limit(0)
        return rows.withColumn("embedding_status", F.lit("pending")), vectors, outcome.select("id", "outcome", "stored_id")
    made = embed(wanted.select("id", "text")).where(F.size("embedding") > 0).select("id", "embedding")
    vectors = written(made.join(wanted.select("id", "content_hash"), "id").select(F.col("id").alias("memory_id"), "embedding", F.lit(model_name).alias("model_name"), "content_hash"), "vectors")
    tried = wanted.select("id", F.lit("failed").alias("_tried"))
    done = vectors.select(F.col("memory_id").alias("id"), F.lit("success").alias("_done"))
    status = F.coalesce("_done", "_tried", F.lit("pending")).alias("embedding_status")
    return rows.join(tried, "id", "left").join(done, "id", "left").select(*rows.columns, status), vectors, outcome.select("id", "outcome", "stored_id")


def migrate(rows: DataFrame) -> DataFrame:
    """Rows of any earlier schema as rows of this one: columns that came later are there, and null; rows of a later schema are an error when they are read."""
    version = F.coalesce(F.col("schema_version"), F.lit(0)) if "schema_version" in rows.columns else F.lit(0)
    later = {"content_hash": tx.content_hash(F.col("searchable_text")), "embedding_status": F.lit("pending"), "metadata": F.lit(None).cast("map<string,string>")}
    out = rows.withColumns({c: value for c, value in later.items() if c not in rows.columns})
    known = F.when(version <= SCHEMA_VERSION, F.lit(SCHEMA_VERSION)).otherwise(F.raise_error(F.lit("rows of a later schema")).cast("int"))
    return out.withColumn("schema_version", known)
