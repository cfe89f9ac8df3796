"""Relations as state: snapshots, neighbours, bounded traversal, and the biases that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.scoring import RELATION_BOOST


def live(relations: DataFrame, now: Column) -> DataFrame:
    return relations.where(F.col("valid_until").isNull() | (F.col("valid_until") > now))


def relate(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that are there already stay as they are."""
    key = ["source_id", "target_id", "relation"]
    return relations.unionByName(new.dropDuplicates(key).join(relations, key, "left_anti"))


def unrelate(relations: DataFrame, gone: DataFrame) -> DataFrame:
    return relations.join(gone, ["source_id", "target_id", "relation"], "left_anti")


def snapshot(ids: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    """memory_id, is_superseded, supersedes_other, in_conflict: one aggregate over edges, no lookup a row."""
    edges = live(relations, now).where(F.col("relation").isin("superseded_by", "conflicts_with"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("memory_id"), F.lit(True).alias("out"), "relation"), F.struct(F.col("target_id").alias("memory_id"), F.lit(False).alias("out"), "relation"))).alias("e")).select("e.*")
    superseded = F.col("relation") == "superseded_by"
    flags = ends.groupBy("memory_id").agg(F.bool_or(superseded & F.col("out")).alias("is_superseded"), F.bool_or(superseded & ~F.col("out")).alias("supersedes_other"), F.bool_or(~superseded).alias("in_conflict"))
    no = F.lit(False)
    return ids.join(flags, "memory_id", "left").select("memory_id", *[F.coalesce(c, no).alias(c) for c in ("is_superseded", "supersedes_other", "in_conflict")])


def successors(candidates: DataFrame, relations: DataFrame, now: Column, backward: bool = False) -> DataFrame:
    """(query_id, memory_id, score) of the rows that supersede the candidates, or that they supersede; a row with several
    parents takes the best one. Rows that are candidates already are not injected."""
    factor, here, there = (0.97, "target_id", "source_id") if backward else (0.99, "source_id", "target_id")
    edges = live(relations, now).where("relation = 'superseded_by'").select(F.col(here).alias("memory_id"), F.col(there).alias("other"))
    found = candidates.join(edges, "memory_id").groupBy("query_id", F.col("other").alias("memory_id")).agg(F.max("score").alias("score"))
    return found.join(candidates, ["query_id", "memory_id"], "left_anti").select("query_id", "memory_id", (F.col("score") * factor).alias("score"))


def traverse(seeds: DataFrame, relations: DataFrame, now: Column, depth: int = 2) -> DataFrame:
    """seed, memory_id, depth, relation: breadth first along live edges, each node at its least depth; a join a level."""
    edges = live(relations, now).select("source_id", "target_id", F.col("relation").alias("edge"))
    front = seeds.select("seed", F.col("seed").alias("memory_id"), F.lit(0).alias("depth"), F.lit("").alias("relation"))
    seen = front
    for d in range(1, depth + 1):
        step = front.join(edges, F.col("memory_id") == F.col("source_id")).groupBy("seed", "target_id").agg(F.min("edge").alias("relation")).withColumnRenamed("target_id", "memory_id")
        front = step.join(seen, ["seed", "memory_id"], "left_anti").select("seed", "memory_id", F.lit(d).alias("depth"), "relation")
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def graph_scores(candidates: DataFrame, reached: DataFrame) -> DataFrame:
    """Scores of reached rows: seed's score / (depth + 1), times the relation's boost; the best of all ways."""
    boost = F.lit(0.75)
    for name, value in RELATION_BOOST.items():
        boost = F.when(F.col("relation") == name, value).otherwise(boost)
    ways = candidates.select("query_id", F.col("memory_id").alias("seed"), F.col("score").alias("seed_score")).join(reached, "seed").select("query_id", "memory_id", (F.col("seed_score") / (F.col("depth") + 1) * boost).alias("score"))
    return candidates.select("query_id", "memory_id", "score").unionByName(ways).groupBy("query_id", "memory_id").agg(F.round(F.max("score"), 6).alias("score"))


def _asked(flag: bool | Column) -> Column:
    return flag if isinstance(flag, Column) else F.lit(flag)


def temporal_bias(candidates: DataFrame, newer: bool | Column = True) -> DataFrame:
    """Up to a tenth more or less by the place of created_at between the query's oldest and newest row; none where newer is null. A list is what a search
    has let through, so its window is bounded by the limit."""
    newer = _asked(newer)
    w = Window.partitionBy("query_id")
    at = F.unix_seconds(F.col("created_at").cast("timestamp")).cast("double")
    low, high = F.min(at).over(w), F.max(at).over(w)
    past = F.when(newer, at - low).otherwise(high - at)
    return candidates.withColumn("score", F.col("score") * F.when((high > low) & newer.isNotNull(), F.lit(0.9) + F.lit(0.2) * past / (high - low)).otherwise(1.0))


def state_bias(score: Column, current: bool | Column, now: Column) -> Column:
    """The score, weighed in turn by is_superseded, supersedes_other, valid_until, valid_from and in_conflict; as it is where current is null."""
    current = _asked(current)
    flags = [F.col("is_superseded"), F.col("supersedes_other"), F.col("valid_until") <= now, F.col("valid_from") > now, F.col("in_conflict")]
    weights = zip(flags, [0.42, 1.18, 0.6, 0.75, 0.97], [1.3, 0.82, 1.08, 0.7, 0.97], strict=True)
    for flag, now_weight, then_weight in weights:
        score = score * F.when(flag & current, now_weight).when(flag & ~current, then_weight).otherwise(1.0)
    return score


def linked_demotion(candidates: DataFrame, relations: DataFrame, now: Column, newer: bool | Column = True) -> DataFrame:
    """For each linked pair among a query's rows the loser weighs 0.72: the superseded one, else the older (or newer) one; none where newer is null."""
    edges = live(relations, now).select("source_id", "target_id", "relation")
    a = candidates.select("query_id", F.col("memory_id").alias("source_id"), F.col("created_at").alias("at_s"), _asked(newer).alias("newer")).where("newer IS NOT NULL")
    b = candidates.select("query_id", F.col("memory_id").alias("target_id"), F.col("created_at").alias("at_t"))
    pairs = edges.join(a, "source_id").join(b, ["query_id", "target_id"])
    older = F.when(F.col("at_s") < F.col("at_t"), F.col("source_id")).when(F.col("at_t") < F.col("at_s"), F.col("target_id"))
    later = F.when(F.col("at_s") < F.col("at_t"), F.col("target_id")).when(F.col("at_t") < F.col("at_s"), F.col("source_id"))
    plain = F.when(F.col("newer"), older).otherwise(later)
    loser = F.when(F.col("relation") == "superseded_by", F.when(F.col("newer"), F.col("source_id")).otherwise(F.col("target_id"))).otherwise(plain)
    lost = pairs.select("query_id", F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y"), loser.alias("memory_id")).where(F.col("memory_id").isNotNull()).groupBy("query_id", "x", "y").agg(F.min("memory_id").alias("memory_id"))
    times = lost.groupBy("query_id", "memory_id").agg(F.count(F.lit(1)).alias("_n"))
    return candidates.join(times, ["query_id", "memory_id"], "left").withColumn("score", F.col("score") * F.pow(F.lit(0.72), F.coalesce("_n", F.lit(0)))).drop("_n")
