"""Reflected knowledge from rows, its written form, and what becomes of it.

An object is what lifecycle.reflect() finds of a key. A written row has the object's columns, and memory_id, status (current, contested, superseded,
retired), generated_at, valid_until and replaced_by. Keys and summaries are compared in normal form.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import scoring as sc
from tidepool.operators import lifecycle
from tidepool.operators.answers import subject_label

# The kinds with their synonyms, and the wording from which the kind of a semantic row follows.
KINDS = {"stable-fact": ["stable-fact", "fact"], "stable-preference": ["stable-preference", "preference"], "stable-decision": ["stable-decision", "decision"], "stable-procedure": ["stable-procedure", "procedure", "procedural"]}
# (patterns for lower-case texts from their first word on: a word with another behind it, and, where so marked, one before; HELD: what a text must hold for that)
_BEFORE, _BEHIND = "(?<=[^a-z0-9_-])", "[^a-z0-9_-]+[a-z0-9_-]"
PREFERS, DECIDES = f"(?<![a-z0-9_-])prefer{_BEHIND}|{_BEFORE}preference{_BEHIND}", f"(?<![a-z0-9_-])decision{_BEHIND}|{_BEFORE}(?:decided|plan){_BEHIND}"
HELD = {PREFERS: ["prefer"], DECIDES: ["decision", "decided", "plan"]}
SHORTEST_SENTENCE, LABEL_WORDS, MOST_OBJECTS = 18, 4, 12
CONFIDENCE = ["low", "medium", "high"]
ACTIVE = ["current", "contested"]
MEASURES = ["support", "trusted", "authoritative", "authority", "provenance"]
RIVAL = ["rival_summary", "rival_support", "rival_trusted"]
OBJECT = ["knowledge_key", "summary", *MEASURES, "confidence", "contested", "unresolved", *RIVAL]


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value): a lambda's variable, so that value is computed once, however often it is used. Named columns would be put in wherever they are used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _filled(text: Column) -> Column:
    """Null if it is empty."""
    return _once(text, lambda x: F.when(x != "", x))


def _given(text: Column) -> Column:
    """Without blanks around it; null if nothing is left."""
    return _filled(_strip(text))


def normal(text: Column) -> Column:
    """Lower case; all but ASCII letters, digits, - and _ one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", " "))


def knowledge_key(text: Column, given: Column) -> Column:
    """The key that a row states, else its first words as a slug; null where there is neither."""
    return F.coalesce(_given(given), _filled(F.replace(normal(subject_label(text)), F.lit(" "), F.lit("-"))))


def summary(text: Column, given: Column) -> Column:
    """The summary that a row states, else the first sentence of its first line behind a label; the line if the sentence is short."""

    def behind_label(line: Column) -> Column:
        words = lambda part: F.size(F.filter(F.split(part, r"\s+"), lambda w: w != ""))
        return _once(F.split(line, ":", 2), lambda parts: F.when((F.size(parts) == 2) & (words(parts[0]) <= LABEL_WORDS), _strip(F.get(parts, F.lit(1)))).otherwise(line))

    def first_sentence(said: Column) -> Column:
        return _once(_strip(F.split(said, "[.!?]", 2)[0]), lambda sentence: F.when(F.octet_length(sentence) >= SHORTEST_SENTENCE, sentence).otherwise(said))

    line = _strip(F.regexp_extract(text, r"^\s*+([^\n]*)", 1))
    return F.coalesce(_given(given), _filled(_once(_once(line, behind_label), first_sentence)))


def kind(memory_type: Column, text: Column, given: Column) -> Column:
    """The kind that a row states, else what its type and wording say."""

    def named(given: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in KINDS.items():
            out = F.when(given.isin(words), name).otherwise(out)
        return out

    def says(low: Column, pattern: str) -> Column:
        return reduce(or_, [F.contains(low, F.lit(w)) for w in HELD[pattern]]) & F.regexp_like(F.regexp_replace(low, "^[^a-z0-9_-]+", ""), F.lit(pattern))

    semantic = _once(F.lower(text), lambda low: F.when(says(low, PREFERS), "stable-preference").when(says(low, DECIDES), "stable-decision"))
    own = F.when(memory_type == "procedural", F.lit("stable-procedure")).when(memory_type == "semantic", semantic)
    return F.coalesce(_once(normal(given), named), own, F.lit("stable-fact"))


def candidates(memories: DataFrame, now: Column) -> DataFrame:
    """id, knowledge_key, summary, kind, trusted, provenance, created_at of rows that reflection may use: with text, not derived themselves, without secrets, not
    held back by a review, not untrusted. memories: the table's columns, review_required, review_status, review_expires_at, secret_class, and, or null,
    derived_kind and the stated knowledge_key, knowledge_summary and knowledge_kind."""
    text, trust = F.col("searchable_text"), sc.trust_level(F.col("source_trust"))
    held = sc.effective_review(F.col("review_status"), F.col("review_required"), F.col("review_expires_at"), now).isin("pending", "denied", "expired")
    derived = F.lower("derived_kind") == "reflection"
    usable = memories.where(F.regexp_like(text, F.lit(r"\S")) & ~F.coalesce(derived, F.lit(False)) & F.col("secret_class").isNull() & ~F.coalesce(held, F.lit(False)) & (trust != "untrusted"))
    found = usable.select(
        "id",
        # inline(): the filter on these two is not pushed below, where all of it would be computed once more
        F.inline(F.array(F.struct(knowledge_key(text, F.col("knowledge_key")).alias("knowledge_key"), summary(text, F.col("knowledge_summary")).alias("summary")))),
        kind(F.col("memory_type"), text, F.col("knowledge_kind")).alias("kind"),
        trust.isin("trusted", "normal").alias("trusted"),
        sc.provenance_rank(F.col("source_kind"), F.col("source_verification")).cast("long").alias("provenance"),
        "created_at",
    )
    return found.where(F.col("knowledge_key").isNotNull() & F.col("summary").isNotNull())


def strongest(objects: DataFrame, most: int = MOST_OBJECTS) -> DataFrame:
    """The objects to report: by confidence, trusted support, support and key."""
    return objects.orderBy(F.array_position(F.lit(CONFIDENCE), F.col("confidence")).desc(), F.col("trusted").desc(), F.col("support").desc(), "knowledge_key").limit(most)


def written(objects: DataFrame, now: Column) -> DataFrame:
    """The rows of objects. Their ids are hashes of key and summary, so that writing again gives the same rows."""
    ids = F.xxhash64(normal(F.col("knowledge_key")), normal(F.col("summary")))
    status = F.when(F.col("unresolved"), "contested").otherwise("current")
    return objects.select(ids.alias("memory_id"), *OBJECT, status.alias("status"), now.alias("generated_at"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.lit(None).cast("long").alias("replaced_by"))


def persist(objects: DataFrame, persisted: DataFrame, now: Column) -> DataFrame:
    """The written rows after objects are written: a row of the same key and summary is replaced, rows of the key with another summary are
    superseded and end now, the others stay. objects: one a key."""
    new = written(objects, now)
    found = new.select(normal(F.col("knowledge_key")).alias("_key"), normal(F.col("summary")).alias("_summary"), F.col("memory_id").alias("_id"))
    both = persisted.withColumn("_k", normal(F.col("knowledge_key"))).join(found, F.col("_k") == F.col("_key"), "left").where(~F.coalesce(F.col("memory_id") == F.col("_id"), F.lit(False)))
    other = F.coalesce(normal(F.col("summary")) != F.col("_summary"), F.lit(False))
    changed = {"status": F.lit("superseded"), "valid_until": now, "replaced_by": F.col("_id")}
    kept = both.select([F.when(other, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in new.columns])
    return kept.unionByName(new)


def superseding_edges(persisted: DataFrame) -> DataFrame:
    """source_id, target_id, relation of superseded rows."""
    return persisted.where((F.col("status") == "superseded") & F.col("replaced_by").isNotNull()).select(F.col("memory_id").alias("source_id"), F.col("replaced_by").alias("target_id"), F.lit("superseded_by").alias("relation"))


def retire(persisted: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The written rows with the active ones of keys (knowledge_key, in normal form) retired: they end now and are replaced by nothing."""
    gone = keys.select(F.col("knowledge_key").alias("_key"), F.lit(True).alias("_gone")).distinct()
    both = persisted.withColumn("_k", normal(F.col("knowledge_key"))).join(gone, F.col("_k") == F.col("_key"), "left")
    ends = F.coalesce(F.col("_gone"), F.lit(False)) & F.col("status").isin(ACTIVE)
    changed = {"status": F.lit("retired"), "valid_until": now, "replaced_by": F.lit(None).cast("long")}
    return both.select([F.when(ends, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in persisted.columns])


def active(persisted: DataFrame) -> DataFrame:
    """The newest active row of each key."""
    rows = persisted.where(F.col("status").isin(ACTIVE)).withColumn("_k", normal(F.col("knowledge_key"))).withColumn("_o", F.struct("generated_at", "memory_id"))
    return lifecycle.newest(rows, "_k", "_o").drop("_k", "_o")


def refresh_plan(objects: DataFrame, persisted: DataFrame, now: Column, max_age_hours: int | None = 24, growth: int = 1, drop: int = 1) -> DataFrame:
    """knowledge_key (in normal form), action (persist or retire), reasons (joined by commas): the keys whose written row no longer tells what the rows say.
    growth, drop: by how much support has to change."""
    a = objects.select(normal(F.col("knowledge_key")).alias("knowledge_key"), F.struct(*OBJECT).alias("a"))
    b = active(persisted).select(normal(F.col("knowledge_key")).alias("knowledge_key"), F.struct(*OBJECT, "generated_at").alias("b"))
    both = a.join(b, "knowledge_key", "full")
    here, there = F.col("a").isNotNull(), F.col("b").isNotNull()
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    rival_changed = F.greatest(*[~x(c).eqNullSafe(y(c)) for c in RIVAL])
    stale = F.lit(False) if max_age_hours is None else F.coalesce(y("generated_at") <= now - F.make_dt_interval(hours=F.lit(max_age_hours)), F.lit(True))
    told = [
        ("summary-changed", normal(x("summary")) != normal(y("summary"))),
        ("support-growth", x("support") >= y("support") + growth),
        ("trusted-support-growth", x("trusted") >= y("trusted") + growth),
        ("authority-strengthened", (x("authoritative") > y("authoritative")) | (x("authority") > y("authority"))),
        ("provenance-strengthened", x("provenance") > y("provenance")),
        ("support-weakened", y("support") >= x("support") + drop),
        ("trusted-support-weakened", y("trusted") >= x("trusted") + drop),
        ("authority-weakened", (y("authoritative") > x("authoritative")) | (y("authority") > x("authority"))),
        ("provenance-weakened", y("provenance") > x("provenance")),
        ("competing-trusted-summary", (x("rival_trusted") > 0) & (~y("contested") | rival_changed)),
        ("unresolved-authoritative-conflict", x("unresolved") & (~y("unresolved") | ~x("rival_summary").eqNullSafe(y("rival_summary")))),
        ("stale-by-age", stale),
    ]
    reasons = [F.when(here & ~there, "missing-persisted"), F.when(~here & there, "no-longer-qualifies")] + [F.when(here & there & hit, name) for name, hit in told]
    out = both.select("knowledge_key", F.when(here, "persist").otherwise("retire").alias("action"), F.array_join(F.array_compact(F.array(*reasons)), ",").alias("reasons"))
    return out.where("reasons <> ''")


def refresh(plan: DataFrame, objects: DataFrame, persisted: DataFrame, now: Column) -> DataFrame:
    """The written rows after the plan: its objects are persisted, its keys without an object retired."""
    due = plan.where("action = 'persist'").select(F.col("knowledge_key").alias("_key"))
    fresh = objects.withColumn("_k", normal(F.col("knowledge_key"))).join(due, F.col("_k") == F.col("_key"), "left_semi").drop("_k")
    return retire(persist(fresh, persisted, now), plan.where("action = 'retire'"), now)
