"""Does a row's text bear on what a query asks? Words in a canonical form, counted as arrays; the query's own signals come from its route."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.plans.route import Query
from tidepool.sources.folder import written

# Words without weight, words taken for another, and words that ask for a detail.
WEIGHTLESS = "the a an is are was were be been being to for of in on at by and or that this it its still then than because what which who should not do does did yet after before over under with without from into about no current earlier".split()
SYNONYMS = {"keep": "prefer", "used": "prefer", "use": "prefer", "tried": "first", "try": "first", "improved": "better", "good": "better", "looked": "better", "happen": "run", "performed": "run", "built": "build", "preferred": "prefer"}
UNITS = "hour minute day date month year dollar".split()
VAGUE_DETAIL = "exact precise specific total publish published release".split()
DETAIL = (
    VAGUE_DETAIL
    + UNITS
    + "cost token price version number id first second third fourth fifth reserved remove removed fail failed duration filename file path endpoint hostname host address port subnet network range cidr script runner label header deployment parameter value hnsw subtype plist hash threshold emotion".split()
)
FOUND = ["wording", "strict", "together", "yes_no", "artifact", "constraint", "intent"]
EXCLUSION = ["except", "without", "excluding", "not with"]

# What asks for a sort of text, what shows it, and the factors where it is shown and where not.
ARTIFACTS = ["scripts/", "target/", ".db", ".json", ".sh", ".sql", ".md", ".toml"]
SUPPORT = ["support", "approved", "enabled", "stateful"]
NEXT = ["next validation step", "come next", "rather than continuing"]
PREREQUISITE = ["before", "had to be completed", "complete ann", "pending explicit user approval"]
LIMIT = ["did not", "not test", "not prove", "cannot", "can not"]
PREFER = ["matters more", "matter more", "rather than", "prioritize"]
CURRENT = ["current", "right now", "latest", "active", "prefer", "going with", "using now", "final"]
HISTORICAL = ["earlier", "previous", "before", "prior", "used to", "originally", "initial", "formerly", "at first"]
SHARED = ["auth", "expose", "bind", "token", "credential", "password", "service", "directly"]
#: Intent: factors of texts that show the state asked for and of those that show the other one.
STATES = {"current-state": (1.55, 0.8), "stable-summary": (1.6, 0.78), "historical-state": (1.5, 0.82)}


def meaning(text: Column) -> Column:
    """The words of a text that carry meaning, repeats kept: synonyms joined, and the endings ing, ed and s cut, in that order."""
    synonyms = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    words = F.filter(tx.tokens(text), lambda w: ~w.isin(WEIGHTLESS))
    named = F.transform(words, lambda w: F.coalesce(F.element_at(synonyms, w), w))
    cut = F.transform(named, lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "(ing)+$", ""), "(ed)+$", ""), "s+$", ""))
    return F.filter(cut, lambda w: w != "")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.filter(tx.tokens(text), lambda w: w.rlike("[0-9]")))


def asked(queries: DataFrame) -> DataFrame:
    """query_id, query, wording, strict, together, yes_no, artifact, constraint, intent: what only the query's own words tell, those of wording where there is such a column (the
    query without what it names). One row a query; a null query asks nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [Query(x or "") for x in b["wording"]]
            yield b.assign(strict=[q.strict for q in found], together=[q.together for q in found], yes_no=[q.yes_no for q in found], artifact=[q.artifact for q in found], constraint=[q.constraint for q in found], intent=[q.intent for q in found])

    own = F.coalesce("wording", "query") if "wording" in queries.columns else F.col("query")
    return queries.select("query_id", "query", own.alias("wording")).mapInPandas(run, "query_id long, query string, wording string, strict boolean, together boolean, yes_no boolean, artifact boolean, constraint boolean, intent string")


def grounded(query: Column, text: Column, strict: Column, together: Column, yes_no: Column) -> Column:
    """Whether the text shares two words, or half of all, with the query. A strict query also needs its details, units and numbers in it;
    one that asks for things together gets a text that excludes one of them only for a yes or no."""
    q, t = meaning(query), F.array_distinct(meaning(text))
    overlap = F.size(F.filter(q, lambda w: F.array_contains(t, w)))
    of = lambda words: F.filter(q, lambda w: w.isin(words))
    within = lambda part: F.size(F.array_except(part, t)) == 0
    detail, specific = of(DETAIL), of([w for w in DETAIL if w not in VAGUE_DETAIL])
    exact = F.when(F.size(specific) > 0, within(specific)).otherwise((F.size(detail) == 0) | F.arrays_overlap(detail, t))
    exact = exact & within(of(UNITS)) & (F.size(F.array_except(numbers(query), numbers(text))) == 0)
    enough = (F.size(q) > 0) & ((overlap >= 2) | (overlap / F.size(q) >= 0.5))
    excludes = F.greatest(*[F.contains(tx.normalize(text), F.lit(p)) for p in EXCLUSION])
    return F.coalesce(F.when(together & excludes, yes_no).otherwise(enough & (~strict | exact)), F.lit(False))


def ground(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds grounded. candidates: query_id and searchable_text; queries: query_id, query. A row whose query is not listed has none."""
    both = candidates.join(asked(queries), "query_id", "left")
    flag = grounded(F.col("query"), F.col("searchable_text"), F.col("strict"), F.col("together"), F.col("yes_no"))
    return both.withColumn("grounded", flag).drop("query", *FOUND)


def _any(text: Column, phrases: list[str]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(p)) for p in phrases])


#: What a text has to be looked at for, by what a query asks for.
SHOWN_FOR = {
    "artifact": ["file"], "truth": ["truth"], "support": ["support"], "constraint": ["shared"], "next": ["next"], "before": ["before"], "limit": ["limit"], "prefer": ["prefer"], "abstention-risk": ["exclusion", "limit"],
    "current-state": ["current", "past"], "stable-summary": ["current", "support", "prefer", "past"], "historical-state": ["past", "current"],
}
_PLACES = [*SHARED, "0 0 0 0", "127 0 0 1"]


def _prefers(text: Column) -> Column:
    return F.arrays_overlap(F.split(text, " "), F.lit(["prefer", "preferred", "preference"]))


def asks_for(q: Column, artifact: Column, constraint: Column, intent: Column) -> dict[str, Column]:
    """What a query (in normal form) asks for, by the names of SHOWN_FOR."""
    truth = F.contains(q, F.lit("source of truth"))
    return {
        "artifact": artifact, "truth": artifact & truth, "support": _any(q, SUPPORT), "constraint": constraint, "next": F.array_contains(F.split(q, " "), "next"), "before": _any(q, ["before", "had to be completed"]),
        "limit": _any(q, ["did not", "not test", "not prove", "alone prove"]), "prefer": _any(q, ["matters more than", "rather than", "prioritize"]) | _prefers(q), "abstention-risk": intent == "abstention-risk",
    } | {name: intent == name for name in STATES}


def shown(t: Column, low: Column) -> dict[str, Column]:
    """What a text (in normal form, and in lower case) shows."""
    return {
        "file": _any(low, ARTIFACTS), "truth": F.contains(t, F.lit("source of truth")), "support": _any(t, SUPPORT) | F.contains(low, F.lit("codex-cli")), "shared": F.array(*[F.contains(t, F.lit(p)) for p in _PLACES]), "next": _any(t, NEXT),
        "before": _any(t, PREREQUISITE), "limit": _any(t, LIMIT), "prefer": _any(t, PREFER) | _prefers(t), "exclusion": _any(t, EXCLUSION), "current": _any(t, CURRENT), "past": _any(t, HISTORICAL),
    }


def shows(text: Column, names: list[str]) -> Column:
    """A struct of what shown() says of a text under the names; its forms are made once."""
    forms = F.array(F.struct(tx.normalize(text).alias("t"), F.lower(text).alias("low")))
    return F.transform(forms, lambda x: F.struct(*[flag.alias(name) for name, flag in shown(x["t"], x["low"]).items() if name in names]))[0]


def factor_of(q: Column, asks: dict[str, Column], has: Callable[[str], Column]) -> Column:
    """The product of a factor for each thing that the query asks for: above one where the text shows it (has), below where not."""
    shared = sum((w * (F.contains(q, F.lit(p)) & has("shared")[n]).cast("int") for n, (p, w) in enumerate(zip(_PLACES, [1] * len(SHARED) + [2, 2], strict=True))), F.lit(0)) >= 2
    asked_for = [
        ("artifact", has("file"), 1.45, 0.82), ("truth", has("truth"), 1.35, 0.82), ("support", has("support"), 1.45, 0.82), ("constraint", shared, 1.55, 0.62), ("next", has("next"), 1.5, 0.8), ("before", has("before"), 1.45, 0.84),
        ("limit", has("limit"), 2.4, 0.45), ("prefer", has("prefer"), 1.65, 0.78), ("abstention-risk", has("exclusion") | has("limit"), 1.1, 0.95),
    ]
    out = F.lit(1.0)
    for name, flag, up, down in asked_for:
        out = out * F.when(asks[name], F.when(flag, up).otherwise(down)).otherwise(1.0)
    for name, (up, down) in STATES.items():
        current = has("current")
        own, other = (has("past"), current) if name == "historical-state" else (current | has("support") | has("prefer") if name == "stable-summary" else current, has("past"))
        out = out * F.when(asks[name], F.when(own, up).when(other, down).otherwise(1.0)).otherwise(1.0)
    return F.coalesce(out, F.lit(1.0))


def alignment(query: Column, text: Column, artifact: Column, constraint: Column, intent: Column) -> Column:
    """factor_of() a query and a text; their forms are made once."""
    forms = F.array(F.struct(tx.normalize(query).alias("q"), tx.normalize(text).alias("t"), F.lower(text).alias("low")))

    def of(x: Column) -> Column:
        flags = shown(x["t"], x["low"])
        return factor_of(x["q"], asks_for(x["q"], artifact, constraint, intent), lambda name: flags[name])

    return F.coalesce(F.transform(forms, of)[0], F.lit(1.0))


def weighed(candidates: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """align() of candidates without texts: each text is looked at once, for what any of the queries asks for, and what it shows goes to the rows in its place; rows whose
    query asks for nothing are as they are. texts: memory_id, searchable_text, one row a memory_id."""
    signals = asked(queries)
    q = tx.normalize(F.col("wording"))
    asks = asks_for(q, F.col("artifact"), F.col("constraint"), F.col("intent"))
    own = written(signals.select("query_id", q.alias("_q"), *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in asks.items()]).where(F.greatest(*map(F.col, asks))), "asks")
    found = own.agg(*[F.coalesce(F.max(name), F.lit(False)).alias(name) for name in asks]).first()
    names = sorted({flag for name in asks if found[name] for flag in SHOWN_FOR[name]})
    if not names:
        return candidates
    flags = texts.select("memory_id", shows(F.coalesce("searchable_text", F.lit("")), names).alias("_shows"))
    both = candidates.join(own.withColumnsRenamed({name: f"_{name}" for name in asks}), "query_id")
    none = F.array(*[F.lit(False) for _ in _PLACES])
    factor = factor_of(F.col("_q"), {name: F.col(f"_{name}") for name in asks}, lambda name: F.col("_shows")[name] if name in names else none if name == "shared" else F.lit(False))
    told = both.join(flags, "memory_id").withColumn("score", F.col("score") * factor).select(candidates.columns)
    return candidates.join(own.select("query_id"), "query_id", "left_anti").unionByName(told)


def align(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Weighs score by how the text suits the query. candidates: with searchable_text; queries: query_id, query. A row whose query is not
    listed, or without text, keeps its score where nothing is asked for."""
    both = candidates.join(asked(queries), "query_id", "left")
    factor = alignment(F.col("wording"), F.coalesce("searchable_text", F.lit("")), F.col("artifact"), F.col("constraint"), F.col("intent"))
    return both.withColumn("score", F.col("score") * factor).drop("query", *FOUND)
