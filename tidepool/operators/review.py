"""The review workflow over a table of items: id, review_required, review_status, review_severity, review_expires_at, review_note, created_at."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.scoring import effective_review

#: Of each approval template the scope, the policy class and the days that it lasts.
TEMPLATES = {
    "staging-bridge": ("staging", "network-exposure-exception", 14),
    "migration-bridge": ("migration", "migration-exception", 7),
    "lab-exception": ("lab", "operational-exception", 30),
    "breakglass-ops": ("production", "breakglass-exception", 1),
    "private-endpoint-bridge": ("production", "private-infrastructure-exception", 14),
    "lab-auth-bypass": ("lab", "auth-bypass-exception", 1),
    "maintenance-reset": ("maintenance", "data-reset-exception", 2),
    "traffic-cutover": ("migration", "traffic-cutover-exception", 3),
}
EXPIRED_NOTE = "Temporary review allowance expired."


def effective(now: Column) -> Column:
    return effective_review(F.col("review_status"), F.col("review_required"), F.col("review_expires_at"), now)


def queue(items: DataFrame, status: str, now: Column, limit: int = 0) -> DataFrame:
    """Items of an effective status, the newest first; pending ones with the expired. limit 0: all."""
    wanted = ["pending", "expired"] if status == "pending" else [status]
    found = items.withColumn("effective_status", effective(now)).where(F.col("effective_status").isin(wanted)).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return found.limit(limit) if limit else found


def expire_due(items: DataFrame, now: Column) -> DataFrame:
    """Elapsed allowances become expired, with a note where there is none."""
    due = (F.col("review_status") == "allowed") & (F.col("review_expires_at") <= now)
    due = F.coalesce(due, F.lit(False))
    note = F.when(due, F.coalesce("review_note", F.lit(EXPIRED_NOTE))).otherwise(F.col("review_note"))
    return items.withColumn("review_note", note).withColumn("review_status", F.when(due, "expired").otherwise(F.col("review_status")))


#: What a decision may say of an item besides, and the item's column for it.
SAID = {"scope": "review_scope", "policy_class": "review_policy_class", "template": "review_template", "reviewer": "reviewer"}


def _known(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with those of the columns that it lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in names if c not in df.columns])


def resolve(items: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Writes decisions into items: status, scope, policy class, template, reviewer and end. What a decision leaves open follows from its template, and else stays as it
    was; the end of an allowance follows from the template alone. decisions: id, status, and, or null, template, scope, policy_class, reviewer,
    expires_at, note, and optionally replaced_by; one a row."""
    items, decisions = _known(items, SAID.values()), _known(decisions, SAID)
    key = F.col("d.template")
    scope, policy, days = F.col("d.scope"), F.col("d.policy_class"), F.lit(None).cast("int")
    for name, (s, p, n) in TEMPLATES.items():
        hit = key == name
        scope, policy, days = F.coalesce(scope, F.when(hit, s)), F.coalesce(policy, F.when(hit, p)), F.coalesce(days, F.when(hit, n))
    ends = F.coalesce(F.col("d.expires_at"), now + F.make_dt_interval(days))
    decided = F.col("d.id").isNotNull()
    both = items.alias("i").join(decisions.alias("d"), F.col("i.id") == F.col("d.id"), "left")
    own = [F.col(f"i.{c}") for c in items.columns if c not in ("review_status", "review_expires_at", "review_note", *SAID.values())]
    said = {"review_scope": scope, "review_policy_class": policy, "review_template": key, "reviewer": F.col("d.reviewer")}
    return both.select(
        *own,
        F.when(decided, F.col("d.status")).otherwise(F.col("i.review_status")).alias("review_status"),
        F.when(decided, F.when(F.col("d.status") == "allowed", ends)).otherwise(F.col("i.review_expires_at")).alias("review_expires_at"),
        F.coalesce(F.col("d.note"), F.col("i.review_note")).alias("review_note"),
        *[F.coalesce(value, F.col(f"i.{name}")).alias(name) for name, value in said.items()],
    )


def item(items: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The items of ids (id) with their effective status; ids without an item, or whose item needs no review, give none."""
    return items.join(ids.select("id").distinct(), "id", "left_semi").withColumn("effective_status", effective(now)).where("effective_status IS NOT NULL")


def with_status(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets statuses as they are given: any status makes a review required; an allowance without an end has none, and a status that is no allowance loses its end.
    changes: id, status, and, or null, expires_at, note; one row an id."""
    changes = changes.select(F.col("id").alias("_id"), "status", *[(F.col(c) if c in changes.columns else F.lit(None)).cast(kind).alias(f"_{c}") for c, kind in (("expires_at", "timestamp_ntz"), ("note", "string"))])
    both, changed = items.join(changes, F.col("id") == F.col("_id"), "left"), F.col("_id").isNotNull()
    new = {
        "review_required": F.when(changed, True).otherwise(F.col("review_required")),
        "review_status": F.when(changed, F.col("status")).otherwise(F.col("review_status")),
        "review_expires_at": F.when(changed, F.when(F.col("status") == "allowed", F.col("_expires_at"))).otherwise(F.col("review_expires_at")),
        "review_note": F.coalesce("_note", "review_note"),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in items.columns])


# Wording that makes a text a warning, the phrases of each tag, and the order in which a tag gives the reason.
PROTECTIVE = ["do not", "should not", "never", "not directly", "rather than", "instead"]
RISKS = {
    "network-exposure": ["0.0.0.0", "let anyone on the lan", "expose the service directly", "public internet"],
    "auth-disable": ["without auth", "no auth", "disable auth", "skip auth"],
    "traffic-cutover": ["cutover", "switch clients", "redirect traffic", "new relay endpoint", "promote the new"],
    "data-reset": ["drop the ann", "drop the tables", "rebuild from scratch", "wipe the index", "truncate"],
    "destructive-command": ["rm -rf", "chmod 777"],
    "secret-handling": ["token", "password", "secret", "private key", "api key", "credential"],
}
CRITICAL = ["network-exposure", "auth-disable", "traffic-cutover"]


def _says(text: Column, phrases: list[str]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(p)) for p in phrases]) if len(phrases) > 1 else F.contains(text, F.lit(phrases[0]))


def detect(records: DataFrame) -> DataFrame:
    """id, tags, severity, reason of procedural rows that should be reviewed; warnings and rows without text are none.
    records: id, memory_type, searchable_text, content_sensitivity."""
    low, kind = F.lower("searchable_text"), F.coalesce(F.lower("content_sensitivity"), F.lit(""))
    hits = {tag: _says(low, phrases) for tag, phrases in RISKS.items()}
    hits["destructive-command"] |= _says(low, ["curl http"]) & _says(low, ["| sh"])
    hits["secret-handling"] |= _says(kind, ["credential", "secret"])
    tags = F.array_compact(F.array(*[F.when(hit, tag) for tag, hit in hits.items()]))
    found = records.where((F.col("memory_type") == "procedural") & ~_says(low, PROTECTIVE)).select("id", tags.alias("_t")).where("size(_t) > 0")
    severity = F.when(F.arrays_overlap("_t", F.lit(CRITICAL)), "critical").otherwise("high")
    return found.select("id", F.array_sort("_t").alias("tags"), severity.alias("severity"), F.element_at("_t", 1).alias("reason"))


def pending_count(items: DataFrame, now: Column) -> DataFrame:
    """n, one row: how many items wait for a decision, the expired ones among them."""
    return queue(items, "pending", now).agg(F.count(F.lit(1)).alias("n"))


def renewed(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions that allow items again; note and end are kept where none is given. asked: id, note, expires_at."""
    both = asked.alias("a").join(items.select("id", "review_note", "review_expires_at"), "id")
    return _decisions(both, "allowed", F.coalesce("a.note", "review_note"), F.coalesce("a.expires_at", "review_expires_at"))


def revoked(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions that deny items; the note is kept where none is given. asked: id, note."""
    return _decisions(asked.alias("a").join(items.select("id", "review_note"), "id"), "denied", F.coalesce("a.note", "review_note"))


def replaced(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions that deny items for others, which the note names. asked: id, replaced_by, note."""
    number = F.col("replaced_by").cast("string")
    named = F.when(F.contains("note", number), F.col("note")).otherwise(F.concat("note", F.lit(" Replacement memory: #"), number, F.lit(".")))
    note = F.coalesce(named, F.concat(F.lit("Replaced by memory #"), number, F.lit(".")))
    return _decisions(asked.join(items.select("id"), "id", "left_semi"), "denied", note, None, F.col("replaced_by"))


def _decisions(asked: DataFrame, status: str, note: Column, ends: Column | None = None, other: Column | None = None) -> DataFrame:
    text, none = F.lit(None).cast("string"), F.lit(None)
    return asked.select("id", F.lit(status).alias("status"), text.alias("template"), text.alias("scope"), text.alias("policy_class"), (none if ends is None else ends).cast("timestamp_ntz").alias("expires_at"), note.alias("note"), (none if other is None else other).cast("long").alias("replaced_by"))


def annotate(records: DataFrame) -> DataFrame:
    """records with review metadata filled in: what detect() finds of a row, as far as its metadata (a map, or null) has no entry of its own. Any review status makes a
    review required."""
    flags = detect(records).select(F.col("id").alias("_id"), "tags", "severity", "reason")
    found = {"review_required": F.lit("true"), "review_severity": F.col("severity"), "review_reason": F.col("reason"), "review_status": F.lit("pending"), "review_tags": F.array_join("tags", ",")}
    own = F.coalesce("metadata", F.expr("map()").cast("map<string,string>"))
    flagged = F.when(F.col("_id").isNotNull(), F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]))
    required = F.when(F.map_contains_key(own, "review_status"), F.create_map(F.lit("review_required"), F.lit("true")))
    defaults = F.coalesce(flagged, required, F.expr("map()").cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)
    both = records.join(flags, F.col("id") == F.col("_id"), "left")
    return both.select(*[c for c in records.columns if c != "metadata"], F.when(F.size(merged) > 0, merged).alias("metadata"))
