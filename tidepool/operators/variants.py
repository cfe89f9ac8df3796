"""Searches in several variants at once, expanded along relations, and the context that follows.

A query is asked as it is, by its key phrases (without stop words) and, where its words ask how things are linked, by what it links. All variants of all queries go
through one search: they are queries with numbers of their own, and share one pass over the texts. What they find is merged by the best weighted score. From
the best rows of a query that asks for links a frontier walks along live relations; a row that it reaches counts with the best product of its seed's score, its
depth and its last relation. A query that asks for guidance is asked as it is alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import lifecycle, rank, retrieve, state
from tidepool.plans.route import Query, route
from tidepool.sources.folder import written

# Words that a query for links drops, weights of the variants and of what a walk's last relation counts for, and of rows that follow or precede a seed's.
LINK_WORDS = set("how does do did is are the a an to through via reach reaches connect connected connection link linked bridge bridges path depends dependency now current currently".split())
LINKS_WEIGHT, FOLLOWED = 1.35, 0.96
RELATION_WEIGHTS = {"superseded_by": 1.2, "validated_by": 1.0, "solved_by": 0.9, "depends_on": 0.9, "related_to": 0.8, "part_of": 0.8}
OTHER_RELATION = 0.75
SEEDS = 20
_STOP = set(tx.STOP_WORDS)
VARIANTS = f"{retrieve.ROUTED}, asked long, weight double, wording string"


@dataclass(frozen=True)
class Assembly:
    """max_per_session: rows of a session in an answer, 0: any. recency_boost: up to so much more for later turns. graph_depth: levels to walk; 0: as the
    query's words ask."""

    max_per_session: int = 1
    recency_boost: float = 0.0
    search_limit: int = 200
    graph_depth: int = 0


def key_phrases(query: str) -> str:
    return " ".join(w for w in query.split(" ") if w and w.lower() not in _STOP) or query


def linked_things(query: str) -> str:
    """What a query for links names; empty if nothing is left or nothing was dropped."""
    words = "".join(c if c.isascii() and c.isalnum() or c in " \t\n\r\f" else " " for c in query.lower()).split()
    left = [w for w in words if w not in LINK_WORDS]
    return " ".join(left) if len(left) < len(words) else ""


def variants_of(query: str) -> list[tuple[str, float]]:
    """Texts and weights, the query itself first."""
    out = [(query, 1.0)]
    q = Query(query)
    if q.guidance:
        return out
    if (phrases := key_phrases(query)) not in ("", query):
        out.append((phrases, 1.0))
    things = linked_things(query) if q.graph else ""
    if things and things not in (query, phrases):
        out.append((things, LINKS_WEIGHT))
    return out


def wording(query: str, names: list[str]) -> tuple[str, Callable[[str], str]]:
    """The query with words that signal nothing in place of the names in it (whole words, case aside), and what puts the names back."""
    known = [re.escape(n) for n in sorted(names, key=len, reverse=True) if n]
    if not known:
        return query, lambda text: text
    mark, found = "namedthing", []
    while mark in query.lower():
        mark += "x"

    def hide(m: re.Match) -> str:
        found.append(m[0])
        return mark + "o" * len(found)

    plain = re.sub(rf"(?<![A-Za-z0-9])({'|'.join(known)})(?![A-Za-z0-9])", hide, query, flags=re.IGNORECASE)
    return plain, lambda text: re.sub(f"{mark}(o+)", lambda m: found[len(m[1]) - 1], text)


def variant_plan(queries: DataFrame, mode: str = "hybrid", depth: str | None = None, rerank_limit: int = 20) -> DataFrame:
    """A plan with a row a variant, routed by its wording: query_id is 4 times the query's (so ids lie within 2^61) plus the variant's number; asked, weight. queries with names
    (an array): what they name is searched for, but is no wording, so a thing called reserved makes no strict query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, query, names in zip(b["query_id"], b["query"], b["names"], strict=True):
                plain, back = wording(query or "", [] if names is None else list(names))
                for n, (text, weight) in enumerate(variants_of(plain)):
                    r, q = route(text, mode, depth or "any", rerank_limit), Query(text)
                    named = "keyword-any" if r.mode == "keyword" and q.precise_procedure else r.mode
                    rows.append((4 * i + n, back(text), named, r.temporal, r.state, r.strict_grounding, r.alignment, q.guidance, r.depth, r.rerank_limit, r.reflection, r.graph_depth, i, weight, text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VARIANTS.split(", ")])

    names = F.col("names") if "names" in queries.columns else F.lit(None).cast("array<string>")
    return queries.select(F.col("query_id").cast("long").alias("query_id"), "query", names.alias("names")).mapInPandas(run, VARIANTS)


def relation_weight(relation: Column) -> Column:
    out = F.lit(OTHER_RELATION)
    for name, value in RELATION_WEIGHTS.items():
        out = F.when(relation == name, value).otherwise(out)
    return out


def expand(seeds: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    """query_id, memory_id, score of what walks along live relations from the seeds reach. seeds: query_id, memory_id, score, levels (how far to walk).

    A frontier holds a row a query and memory, with the best score of a seed that leads there; a memory is walked from again only with a better seed than before. So
    the frontier is no larger than what is reached, whatever the number of walks. Each level is written."""
    edges = state.live(relations, now).select("source_id", "target_id", relation_weight(F.col("relation")).alias("_w"))
    front = seeds.select("query_id", "memory_id", F.col("score").alias("_seed"), "levels")
    best = front.select("query_id", "memory_id", "_seed")
    out = None
    for level in range(1, (seeds.agg(F.max("levels")).first()[0] or 0) + 1):
        steps = front.where(F.col("levels") >= level).join(edges, F.col("memory_id") == F.col("source_id"))
        reached = steps.groupBy("query_id", F.col("target_id").alias("memory_id"), "levels").agg(F.max("_seed").alias("_seed"), F.max(F.col("_seed") / (level + 1) * F.col("_w")).alias("score"))
        reached = written(reached, f"reached-{level}")
        out = reached.select("query_id", "memory_id", "score") if out is None else out.unionByName(reached.select("query_id", "memory_id", "score"))
        known = best.groupBy("query_id", "memory_id").agg(F.max("_seed").alias("_best"))
        front = reached.join(known, ["query_id", "memory_id"], "left").where(F.col("_best").isNull() | (F.col("_seed") > F.col("_best"))).select("query_id", "memory_id", "_seed", "levels")
        best = best.unionByName(front.select("query_id", "memory_id", "_seed"))
    return seeds.select("query_id", "memory_id", "score").limit(0) if out is None else out


def search(
    queries: DataFrame, memories: DataFrame, relations: DataFrame, now: Column, config: Assembly = Assembly(), vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, mode: str = "hybrid", depth: str | None = None, **options
) -> DataFrame:
    """query_id, memory_id, score, rank. queries: query_id, query, or with names (see variant_plan()); one row a query_id. embed(query_id, query) gives query_id, embedding of variants; without it and
    vectors, keyword search. memories with turn_index where recency_boost is not 0, with session where max_per_session is not 0. options: those of retrieve.ranked()."""
    plan = written(variant_plan(queries, mode, depth), "variants")
    k = config.search_limit
    asked = embed(plan.select("query_id", "query")) if embed and vectors is not None else None
    found = retrieve.retrieve(plan, memories, relations, now, k, vectors if asked is not None else None, asked, **options)
    own = plan.where(F.col("query_id") == 4 * F.col("asked")).withColumn("query_id", F.col("asked"))
    own = own.withColumn("levels", F.lit(config.graph_depth) if config.graph_depth else F.col("graph_depth"))
    keys = plan.select(F.col("query_id").alias("_variant"), "asked", "weight")
    merged = found.join(keys, F.col("query_id") == F.col("_variant")).groupBy(F.col("asked").alias("query_id"), "memory_id").agg(F.max(F.col("score") * F.col("weight")).alias("score"))
    if config.recency_boost:
        turns = memories.select(F.col("id").alias("memory_id"), "turn_index")
        merged = rank.position_boost(merged.join(turns, "memory_id"), config.recency_boost).select("query_id", "memory_id", "score")
    merged = written(merged, "merged")

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
    linked = own.where("levels > 0").select("query_id", "levels", "state")
    seeds = merged.join(linked, "query_id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= min(k, SEEDS)).drop("_r")
    lists = [merged, expand(seeds, relations, now)]
    edges = state.live(relations, now).where("relation = 'superseded_by'")
    for asked_for, here, there in (("current", "source_id", "target_id"), ("historical", "target_id", "source_id")):
        ends = edges.select(F.col(here).alias("memory_id"), F.col(there).alias("_other"))
        lists.append(seeds.where(F.col("state") == asked_for).join(ends, "memory_id").select("query_id", F.col("_other").alias("memory_id"), (F.col("score") * FOLLOWED).alias("score")))
    rows = rank.merge(lists)
    flags = state.snapshot(rows.select("memory_id").distinct(), relations, now).select("memory_id", "is_superseded", "supersedes_other")
    rows = rows.join(linked, "query_id", "left").join(flags, "memory_id", "left")
    factor = F.when((F.col("state") == "current") & F.col("is_superseded"), 0.1).when((F.col("state") == "historical") & F.col("supersedes_other"), 0.35).otherwise(1.0)
    rows = rows.select("query_id", "memory_id", (F.col("score") * factor).alias("score"))
    sessions = memories.select(F.col("id").alias("memory_id"), *[c for c in ("session",) if c in memories.columns])
    rows = written(rows.join(own.select("query_id", "strict_grounding", "alignment"), "query_id").join(sessions, "memory_id"), "reached")
    texts = memories.select(F.col("id").alias("memory_id"), "searchable_text")
    rows = retrieve.answering(rows, own.select("query_id", "query", "wording", "strict_grounding", "alignment"), texts)
    if config.max_per_session:
        rows = lifecycle.diversify(rows, config.max_per_session)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).select("query_id", "memory_id", "score", "rank")


def assemble_context(found: DataFrame, memories: DataFrame, budget: int, priority: int = 1) -> DataFrame:
    """query_id, n_items, used_tokens, remaining_tokens, truncated, ids of the best found rows whose texts, behind their session's date, fit into so many
    tokens. found: as search() gives it. memories: with session_date or without."""
    date = F.col("session_date") if "session_date" in memories.columns else F.lit("")
    texts = memories.select(F.col("id").alias("memory_id"), tx.estimated_tokens(tx.dated(F.col("searchable_text"), date)).alias("tokens"))
    items = found.join(texts, "memory_id").select("query_id", "memory_id", F.lit(priority).alias("priority"), F.col("score").alias("relevance"), "tokens")
    return lifecycle.assemble(items, budget)
