"""Ranked lists: lexical rerank, scores for the head, near-duplicate suppression, merging, boosts, source authority, sensitive evidence.

A candidate list has query_id, memory_id, score; what else a function reads is named there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import scoring as sc
from tidepool.functions import text as tx
from tidepool.operators.search import top
from tidepool.sources.folder import shared_dir

#: Kinds of secrets that evidence may point to without holding them.
SENSITIVE = ["credential-location", "secret-reference", "private-endpoint", "internal-hostname", "internal-share-path", "private-network-range"]


def lexical_factor(text: Column, query: Column) -> Column:
    """Up to half as much again for the query's words (0.3) and pairs of words (0.2) that the text contains; very short texts weigh less.
    A query without words changes nothing."""
    plain = F.trim(F.regexp_replace(query, r"\s+", " "))
    words = F.filter(F.split(F.lower(tx.strip_stop_words(plain)), " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    low = F.lower(text)
    share = lambda xs: F.when(F.size(xs) > 0, F.size(F.filter(xs, lambda w: F.contains(low, w))) / F.size(xs)).otherwise(0.0)
    size = F.octet_length(text)
    return F.when(F.size(words) == 0, 1.0).otherwise((1 + share(words) * 0.3 + share(pairs) * 0.2) * F.when(size < 20, 0.3).when(size < 50, 0.7).otherwise(1.0))


def lexical_rerank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """candidates: with searchable_text. queries: query_id, query."""
    both = candidates.join(queries, "query_id")
    return both.withColumn("score", F.col("score") * lexical_factor(F.col("searchable_text"), F.col("query"))).drop("query")


def rerank_head(candidates: DataFrame, scorer: Column, limit: int) -> DataFrame:
    """The first rows of each query take the scorer's score and come in its order; the tail follows with its own scores."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
    ranked = candidates.withColumn("_r", F.row_number().over(w))
    scored = ranked.withColumn("_head", F.col("_r") <= limit).withColumn("score", F.when(F.col("_head"), scorer).otherwise(F.col("score")))
    place = Window.partitionBy("query_id").orderBy(F.col("_head").desc(), F.col("score").desc(), "memory_id")
    return scored.withColumn("rank", F.row_number().over(place)).drop("_r", "_head")


def _near(vectors: np.ndarray, seen: np.ndarray, most: float) -> np.ndarray:
    out = np.zeros(len(vectors), bool)
    for at in range(0, len(seen), 256):
        out |= (vectors @ seen[at : at + 256].T > most).any(1)
    return out


def _vectors(t: pa.Table) -> np.ndarray:
    return np.array(t.column("embedding").to_pylist(), np.float64)


def suppress_near_duplicates(candidates: DataFrame, vectors: DataFrame, most: float = 0.95, limit: int | None = None, block: int = 2000) -> DataFrame:
    """Rows in order of score, without those whose vector is nearer than most to a kept one's; rows without a vector stay. Whole lists, or their limit
    best rows. A list is judged in blocks of ranks, a block a round: first against what each earlier block has kept, a task a pair of blocks, then
    within itself. A task holds two blocks at most; kept rows are written to spark.checkpoint.dir."""
    spark = candidates.sparkSession
    folder = f"{shared_dir(spark)}/suppressed-{uuid.uuid4().hex}"
    one_each = vectors.select("memory_id", "embedding").dropDuplicates(["memory_id"])
    columns = [F.col(c).cast(kind).alias(c) for c, kind in (("query_id", "long"), ("memory_id", "long"), ("score", "double"), ("rank", "long"), ("embedding", "array<double>"))]
    listed = top(candidates, 2**31 - 1 if limit is None else limit).join(one_each, "memory_id", "left").select(*columns).withColumn("block", F.floor((F.col("rank") - 1) / block).cast("long"))
    listed.write.partitionBy("block").parquet(f"{folder}/listed")
    schema = listed.schema
    listed = spark.read.schema(schema).parquet(f"{folder}/listed")

    def across(own: pa.Table, seen: pa.Table) -> pa.Table:
        found = _near(_vectors(own), _vectors(seen), most) if own.num_rows and seen.num_rows else np.zeros(own.num_rows, bool)
        return own.filter(pa.array(found)).select(["query_id", "rank"])

    def within(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        known = np.flatnonzero(t.column("embedding").is_valid().to_numpy())
        gone = np.zeros(t.num_rows, bool)
        if len(known):
            vectors = _vectors(t.take(known))
            near = vectors @ vectors.T > most
            for k in range(1, len(known)):  # a row goes for an earlier one that has stayed
                gone[known[k]] = (near[k, :k] & ~gone[known[:k]]).any()
        return t.filter(pa.array(~gone))

    last = listed.agg(F.max("block")).first()[0]
    paths: list[str] = []
    for k in range(0 if last is None else last + 1):
        own = listed.where(F.col("block") == k)
        if paths:
            seen = spark.read.schema(schema).parquet(*paths).where("embedding IS NOT NULL")
            asked = own.where("embedding IS NOT NULL").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
            gone = asked.groupBy("query_id", "block").cogroup(seen.groupBy("query_id", "block")).applyInArrow(across, "query_id long, rank long").select(F.col("query_id").alias("_q"), F.col("rank").alias("_r"))
            own = own.join(gone, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("rank") == F.col("_r")), "left_anti")
        paths.append(f"{folder}/kept-{k}")
        own.select(schema.names).groupBy("query_id").applyInArrow(within, schema).write.parquet(paths[-1])
    kept = spark.read.schema(schema).parquet(*paths) if paths else listed
    return kept.select("query_id", "memory_id", "score")


def merge(lists: Iterable[DataFrame]) -> DataFrame:
    """The best score of each row over all lists."""
    first, *rest = [x.select("query_id", "memory_id", "score") for x in lists]
    for x in rest:
        first = first.unionByName(x)
    return first.groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))


def two_tiers(everywhere: DataFrame, project: DataFrame, boost: float = 1.5) -> DataFrame:
    """Lists from a common and from a project's own store; the project's weigh more."""
    return merge([everywhere, project.withColumn("score", F.col("score") * boost)])


def position_boost(candidates: DataFrame, boost: float) -> DataFrame:
    """More for later turns. candidates: with turn_index, null where there is none."""
    most = F.greatest(F.max("turn_index").over(Window.partitionBy("query_id")).cast("double"), F.lit(1.0))
    return candidates.withColumn("score", F.col("score") * (1 + F.lit(boost) * F.coalesce(F.col("turn_index").cast("double"), F.lit(0.0)) / most))


def pull_neighbours(candidates: DataFrame, edges: DataFrame, current: bool = True, factor: float = 0.96) -> DataFrame:
    """Rows that supersede a candidate (or that it supersedes) join with most of its score. edges: live superseded_by relations."""
    here, there = ("source_id", "target_id") if current else ("target_id", "source_id")
    found = candidates.join(edges.select(F.col(here).alias("memory_id"), F.col(there).alias("_other")), "memory_id")
    return merge([candidates, found.select("query_id", F.col("_other").alias("memory_id"), (F.col("score") * factor).alias("score"))])


def demote_by_state(candidates: DataFrame, snapshot: DataFrame, current: bool = True) -> DataFrame:
    """Superseded rows nearly vanish where the current state is asked for; their successors weigh less where a former one is."""
    flag, factor = ("is_superseded", 0.1) if current else ("supersedes_other", 0.35)
    known = candidates.join(snapshot.select("memory_id", flag), "memory_id", "left")
    return known.withColumn("score", F.col("score") * F.when(F.col(flag), factor).otherwise(1.0)).drop(flag)


def authority_levels(records: DataFrame, registry: DataFrame) -> DataFrame:
    """memory_id, authority (best rank over the domains), total (their sum), weight. records: memory_id, domains, chain, kind.
    registry: domain, name ('chain' or 'kind'), value, level; small, as it is written by hand."""
    ranked = F.broadcast(registry.select("domain", "name", "value", sc.authority_rank(F.col("level")).alias("_rank")))
    keys = F.explode(F.create_map(F.lit("chain"), F.col("chain"), F.lit("kind"), F.col("kind"))).alias("name", "value")
    asked = records.select("memory_id", F.explode(F.array_distinct("domains")).alias("domain"), "chain", "kind").select("memory_id", "domain", keys)
    best = asked.join(ranked, ["domain", "name", "value"]).groupBy("memory_id", "domain").agg(F.max("_rank").alias("_rank"))
    found = best.groupBy("memory_id").agg(F.max("_rank").cast("long").alias("authority"), F.sum("_rank").cast("long").alias("total"))
    level = authority_weight(F.col("authority"))
    out = records.select("memory_id").join(found, "memory_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("memory_id", F.coalesce("authority", zero).alias("authority"), F.coalesce("total", zero).alias("total"), level.alias("weight"))


def authority_by_domain(records: DataFrame, registry: DataFrame) -> DataFrame:
    """memory_id, domain, authority: each record's best rank in each domain where the registry names its chain or its kind. records: memory_id, source_chain,
    source_kind; registry: domain, name ('chain' or 'kind'), value, level."""
    ranks = registry.select("domain", "name", "value", sc.authority_rank(F.col("level")).alias("_rank"))
    keys = F.explode(F.create_map(F.lit("chain"), F.col("source_chain"), F.lit("kind"), F.col("source_kind"))).alias("name", "value")
    return records.select("memory_id", keys).where("value IS NOT NULL").join(ranks, ["name", "value"]).groupBy("memory_id", "domain").agg(F.max("_rank").cast("long").alias("authority"))


def authority_for(candidates: DataFrame, by_domain: DataFrame, domains: Column) -> DataFrame:
    """candidates with authority: the best rank over the domains of the row's query, 0 where there is none. One row a (query_id, memory_id)."""
    asked = candidates.select("query_id", "memory_id", F.explode(domains).alias("domain"))
    best = asked.join(by_domain, ["memory_id", "domain"]).groupBy("query_id", "memory_id").agg(F.max("authority").alias("authority"))
    return candidates.join(best, ["query_id", "memory_id"], "left").withColumn("authority", F.coalesce("authority", F.lit(0).cast("long")))


def authority_weight(rank: Column) -> Column:
    """The weight of the level that a rank stands for."""
    out = F.lit(1.0)
    for name, value in sc.AUTHORITY_RANK.items():
        out = F.when(rank == value, sc.AUTHORITY_WEIGHT[name]).otherwise(out)
    return out


def best_sensitive(evidence: DataFrame) -> DataFrame:
    """Of the rows that tell where a secret is only the best trusted ones stay, where there is a trusted one at all.
    evidence: query_id, secret_class, trust (level), rank (provenance and authority)."""
    sensitive = F.coalesce(F.col("secret_class").isin(SENSITIVE), F.lit(False))
    rank = F.when(F.col("trust").isin("trusted", "normal"), F.col("rank")).otherwise(0)
    best = F.max(F.when(sensitive, rank)).over(Window.partitionBy("query_id"))
    marked = evidence.withColumn("_keep", ~sensitive | (F.coalesce(best, F.lit(0)) <= 0) | (rank == best))
    return marked.where("_keep").drop("_keep")
