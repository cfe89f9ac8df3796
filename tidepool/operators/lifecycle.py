"""Writes, activation, pruning, reflection and evidence, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as tx

# How fast each type fades, the text of a compacted entry, and the age that its accesses count with.
DECAYS = {"episodic": 0.5, "semantic": 0.2, "procedural": 0.3}
COMPACTED = r"^\[compacted: (\d+) accesses\]$"
COMPACTED_SECONDS = 90 * 86400.0


def store(existing: DataFrame, new: DataFrame) -> DataFrame:
    """id, content_hash, outcome ('added' or 'duplicate'), stored_id of each new row: the first row of a text that is not stored yet is added."""
    hashed = new.select("id", tx.content_hash(F.col("searchable_text")).alias("content_hash"))
    known = existing.select(tx.content_hash(F.col("searchable_text")).alias("content_hash"), "id").groupBy("content_hash").agg(F.min("id").alias("known_id"))
    first = hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    out = hashed.join(first, "content_hash").join(known, "content_hash", "left")
    added = F.col("known_id").isNull() & (F.col("id") == F.col("first_id"))
    return out.select("id", "content_hash", F.when(added, "added").otherwise("duplicate").alias("outcome"), F.coalesce("known_id", "first_id").alias("stored_id"))


def update(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Replaces texts by id, a null text as well; the changed rows' hash follows and their embedding becomes pending. Other rows stay as they
    are, and changes to ids that are not there change nothing. changes: id, searchable_text; one row an id. memories: with embedding_status and content_hash."""
    c = changes.select("id", F.col("searchable_text").alias("_new"), F.lit(True).alias("_changed"))
    pick = lambda new, old: F.when(F.col("_changed"), new).otherwise(F.col(old)).alias(old)
    new = {"searchable_text": F.col("_new"), "content_hash": tx.content_hash(F.col("_new")), "embedding_status": F.lit("pending")}
    return memories.join(c, "id", "left").select([pick(new[x], x) if x in new else F.col(x) for x in memories.columns])


def delete(memories: DataFrame, relations: DataFrame, vectors: DataFrame, access: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the ids of gone (id)."""
    ids = gone.select(F.col("id").alias("memory_id"))
    edges = relations.join(ids.withColumnRenamed("memory_id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("memory_id", "target_id"), "target_id", "left_anti")
    return memories.join(gone.select("id"), "id", "left_anti"), edges, vectors.join(ids, "memory_id", "left_anti"), access.join(ids, "memory_id", "left_anti")


def get(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ids (id); ids that are not there give none."""
    return memories.join(ids.select("id"), "id", "left_semi")


def with_embedding_status(memories: DataFrame, vectors: DataFrame, failed: DataFrame) -> DataFrame:
    """memories and embedding_status: success where there is a vector, failed where the last try is in failed (id), else pending."""
    done = vectors.select(F.col("memory_id").alias("id"), F.lit("success").alias("_done")).distinct()
    bad = failed.select("id", F.lit("failed").alias("_bad")).distinct()
    both = memories.join(done, "id", "left").join(bad, "id", "left")
    return both.select(*memories.columns, F.coalesce("_done", "_bad", F.lit("pending")).alias("embedding_status"))


def embedded_by_text(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows whose text has a vector already, their own or that of a row with the same text."""
    hashed = memories.withColumn("_h", tx.content_hash(F.col("searchable_text")))
    known = hashed.join(vectors.select(F.col("memory_id").alias("id")), "id", "left_semi").select("_h")
    return hashed.join(known, "_h", "left_semi").drop("_h")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by order: an upsert."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def valid_at(when: Column) -> Column:
    """Half-open validity; a missing bound is none."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= when)) & (F.col("valid_until").isNull() | (F.col("valid_until") > when))


def activation(log: DataFrame, now: Column, decay: float = 0.5) -> DataFrame:
    """memory_id, n_accesses, activation: the log of the summed powers of each access's age, term by term."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("accessed_at").cast("timestamp"))
    age = F.greatest(micros / F.lit(1e6), F.lit(0.1))
    return log.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_accesses"), F.sum(-F.lit(decay) * F.log(age)).alias("activation"))


def activation_of(memories: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """memory_id, n_accesses, activation of all rows: a base by importance, a term for each access, which fades by the row's type, and for accesses that
    were compacted (an entry with their number as its text) one of the age at which accesses are. Where the log has none: the base alone."""
    decay = F.lit(DECAYS["episodic"])
    for kind, rate in DECAYS.items():
        decay = F.when(F.col("memory_type") == kind, rate).otherwise(decay)
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("accessed_at").cast("timestamp"))
    n = F.coalesce(F.regexp_extract("query_text", COMPACTED, 1).try_cast("long"), F.lit(0).cast("long"))
    used = log.select("memory_id", F.log(F.greatest(micros / F.lit(1e6), F.lit(0.1))).alias("_age"), n.alias("_n"))
    sums = used.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_accesses"), (F.sum("_age") + F.sum("_n") * F.log(F.lit(COMPACTED_SECONDS))).alias("_ages"))
    both = memories.select(F.col("id").alias("memory_id"), "importance", decay.alias("_decay")).join(sums, "memory_id", "left")
    zero = F.lit(0).cast("long")
    return both.select("memory_id", F.coalesce("n_accesses", zero).alias("n_accesses"), (F.col("importance") / F.lit(10.0) - F.col("_decay") * F.coalesce("_ages", F.lit(0.0))).alias("activation"))


def cached_activation(cache: DataFrame, computed: DataFrame) -> DataFrame:
    """memory_id, activation: the kept figure (cache: memory_id, activation), or the computed one where there is none."""
    kept = cache.select("memory_id", F.col("activation").alias("_kept"))
    return computed.join(kept, "memory_id", "left").select("memory_id", F.coalesce("_kept", "activation").alias("activation"))


def compact(log: DataFrame, now: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(memory_id, last_access, n) of accesses older than so many days, and the log without them."""
    old = F.col("accessed_at") < now - F.make_dt_interval(F.lit(days))
    return log.where(old).groupBy("memory_id").agg(F.max("accessed_at").alias("last_access"), F.count(F.lit(1)).alias("n")), log.where(~old)


def prunable(memories: DataFrame, activations: DataFrame, relations: DataFrame, now: Column, types: tuple[str, ...] = ("episodic",), days: int = 30, least_activation: float = -2.0, exempt_importance: int = 8, derived: DataFrame | None = None) -> DataFrame:
    """Old, seldom used rows of the types, but for important and linked ones, and those from which others are derived (derived: source_ids)."""
    linked = relations.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    if derived is not None:
        linked = linked.unionByName(derived.select(F.explode("source_ids").alias("id")))
    linked = linked.distinct()
    old = memories.where(F.col("memory_type").isin(*types) & (F.col("created_at") < now - F.make_dt_interval(F.lit(days))) & (F.col("importance") < exempt_importance))
    known = old.join(activations.select(F.col("memory_id").alias("id"), "activation"), "id", "left")
    return known.where(F.col("activation").isNull() | (F.col("activation") < least_activation)).join(linked, "id", "left_anti")


def diversify(ranked: DataFrame, per_session: int) -> DataFrame:
    """At most so many rows a session in each query, best first; a row without a session is one of its own."""
    session = F.coalesce(F.col("session"), F.concat(F.lit("\0"), F.col("memory_id").cast("string")))
    w = Window.partitionBy("query_id", session).orderBy(F.col("score").desc(), "memory_id")
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_session).drop("_r")


def distinct_evidence(ranked: DataFrame, top_n: int = 5) -> DataFrame:
    """query_id, total, n_distinct, ids: texts that differ only in case and punctuation count once, for the best row."""
    key = tx.normalize(F.col("searchable_text"))
    w = Window.partitionBy("query_id", key).orderBy(F.col("score").desc(), "memory_id")
    firsts = ranked.select("query_id", "memory_id", "score", F.row_number().over(w).alias("_r"))
    order = Window.partitionBy("query_id").orderBy((F.col("_r") > 1).asc(), F.col("score").desc(), "memory_id")
    placed = firsts.withColumn("_place", F.row_number().over(order))
    # only the rows that are named are gathered
    named = F.when((F.col("_r") == 1) & (F.col("_place") <= top_n), F.struct("_place", F.col("memory_id").cast("string").alias("id")))
    out = placed.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_r") == 1).alias("n_distinct"), F.array_sort(F.collect_list(named)).alias("_b"))
    return out.select("query_id", "total", "n_distinct", F.array_join(F.transform("_b", lambda x: x["id"]), ",").alias("ids"))


def reflect(rows: DataFrame, least_support: int = 2, least_trusted: int = 1) -> DataFrame:
    """knowledge_key, summary, support, trusted, authoritative, authority, provenance, n_rivals, confidence, contested, unresolved, and the runner-up's summary,
    support and trusted rows: of the summaries of a key the one with most authoritative rows, authority, trusted rows, support, provenance, and
    the newest. rows: knowledge_key, summary, trusted, authority, provenance, created_at."""
    groups = rows.groupBy("knowledge_key", "summary").agg(
        F.count(F.lit(1)).alias("support"), F.count_if("trusted").alias("trusted"), F.count_if(F.col("authority") >= 100).alias("authoritative"), F.sum("authority").alias("authority"), F.sum("provenance").alias("provenance"), F.max("created_at").alias("newest")
    )
    good = groups.where((F.col("support") >= least_support) & (F.col("trusted") >= least_trusted))
    order = [F.col(c).desc() for c in ("authoritative", "authority", "trusted", "support", "provenance", "newest")]
    w = Window.partitionBy("knowledge_key").orderBy(*order, "summary")
    ranked = good.withColumn("_r", F.row_number().over(w)).withColumn("_rival", F.lead(F.struct("authoritative", "authority", "trusted", "support", "provenance", "summary")).over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("knowledge_key")))
    tie = F.col("_rival").isNotNull() & (F.col("authoritative") > 0)
    for c in ("authoritative", "authority", "trusted", "support", "provenance"):
        tie = tie & (F.col(f"_rival.{c}") == F.col(c))
    rival = F.coalesce(F.col("_rival.trusted") > 0, F.lit(False))
    level = F.when((F.col("trusted") > least_trusted) & ~rival, "high").when((F.col("trusted") > least_trusted) | ~rival, "medium").otherwise("low")
    none = F.lit(0).cast("long")
    return ranked.where("_r = 1").select(
        "knowledge_key", "summary", "support", "trusted", "authoritative", "authority", "provenance", (F.col("_n") - 1).alias("n_rivals"), level.alias("confidence"), rival.alias("contested"), F.coalesce(tie, F.lit(False)).alias("unresolved"),
        F.col("_rival.summary").alias("rival_summary"), F.coalesce(F.col("_rival.support"), none).alias("rival_support"), F.coalesce(F.col("_rival.trusted"), none).alias("rival_trusted"),
    )


def assemble(items: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """by, n_items, used_tokens, remaining_tokens, truncated, ids: first fit in order of priority and relevance; what is too large is skipped, not the end. One fold over
    each group's (priority, -relevance, id, tokens), which a search's limit bounds."""
    rows = F.array_sort(F.collect_list(F.struct("priority", (-F.col("relevance")).alias("r"), "memory_id", "tokens")))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fits = lambda s, x: s["used"] + x["tokens"] <= F.lit(budget)
    fold = F.aggregate("_rows", empty, lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["tokens"]).alias("used"), F.array_append(s["ids"], x["memory_id"]).alias("ids"))).otherwise(s))
    return items.groupBy(by).agg(rows.alias("_rows")).select(by, F.size("_rows").alias("_all"), fold.alias("f")).select(by, F.size("f.ids").cast("long").alias("n_items"), F.col("f.used").alias("used_tokens"), (F.lit(budget) - F.col("f.used")).alias("remaining_tokens"), (F.size("f.ids") < F.col("_all")).alias("truncated"), F.array_join(F.transform("f.ids", lambda x: x.cast("string")), ",").alias("ids"))
