"""Score multipliers as columns; a composite is their product. The clock is a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights and synonyms of each rule.
TRUSTED = ["trusted", "verified", "maintainer", "system", "high"]
LOW = ["low", "weak", "speculative"]
UNTRUSTED = ["untrusted", "external", "poisoned", "unsafe"]
TRUST_WEIGHT = {"trusted": 1.15, "low": 0.78, "untrusted": 0.45}
TYPE_WEIGHT = {"episodic": 0.8, "semantic": 1.0, "procedural": 1.2}
#: Kind: synonyms, weight, rank.
SOURCE_KINDS = {
    "system": (["system"], 1.08, 60),
    "maintainer": (["maintainer", "maintainer-note"], 1.08, 55),
    "project-doc": (["project-doc", "documentation"], 1.06, 50),
    "local-observation": (["local-observation", "observed-local"], 1.08, 48),
    "user-note": (["user-note"], 1.08, 44),
    "copied-chat": (["copied-chat", "chat-copy"], 0.88, 28),
    "external-web": (["external-web", "web"], 0.8, 18),
    "forum-post": (["forum-post"], 0.8, 14),
}
#: Verification: synonyms, weight, rank.
VERIFICATIONS = {
    "verified": (["verified"], 1.08, 20),
    "observed": (["observed"], 1.08, 18),
    "partially-verified": (["partially-verified", "partial", "partially-observed"], 1.03, 14),
    "declared": (["declared"], 1.0, 10),
    "relayed": (["relayed", "second-hand"], 0.94, 7),
    "copied": (["copied"], 0.9, 5),
    "unverified": (["unverified"], 0.78, 0),
}
UNKNOWN_KIND_RANK, UNKNOWN_VERIFICATION_RANK = 32, 8
AUTHORITY_WEIGHT = {"authoritative": 1.18, "primary": 1.12, "delegated": 1.06, "reference": 1.02}
AUTHORITY_RANK = {"authoritative": 100, "primary": 80, "delegated": 55, "reference": 30}
RELATION_BOOST = {"caused_by": 1.2, "solved_by": 1.2, "depends_on": 1.0, "superseded_by": 1.0, "related_to": 0.9}


def _cases(key: Column, table: dict, default: float | int) -> Column:
    out = F.lit(default)
    for names, value in reversed([([k], v) for k, v in table.items()]):
        out = F.when(key.isin(names), F.lit(value)).otherwise(out)
    return out


def recency(created_at: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """Halves with each half-life of age."""
    age = F.greatest(F.expr("CAST(0 AS DOUBLE)"), F.timestamp_diff("SECOND", created_at, now) / F.lit(86400.0))
    return F.pow(F.lit(2.0), -age / F.lit(max(half_life_days, 0.1)))


def importance(value: Column) -> Column:
    """From 0.5 at 1 to 1.5 at 10."""
    return F.lit(0.5) + (value - 1) / F.lit(9.0)


def memory_type(value: Column) -> Column:
    return _cases(value, TYPE_WEIGHT, 1.0)


def trust_level(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(TRUSTED), "trusted").when(v.isin(LOW), "low").when(v.isin(UNTRUSTED), "untrusted").otherwise("normal")


def source_trust(value: Column) -> Column:
    return _cases(trust_level(value), TRUST_WEIGHT, 1.0)


def _tag(value: Column) -> Column:
    return F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))


def _looked_up(value: Column, table: dict, at: int, default: float | int) -> Column:
    key, out = _tag(value), F.lit(default)
    for row in reversed(list(table.values())):
        out = F.when(key.isin(row[0]), F.lit(row[at])).otherwise(out)
    return out


def source_kind(value: Column) -> Column:
    return _looked_up(value, SOURCE_KINDS, 1, 1.0)


def verification(value: Column) -> Column:
    return _looked_up(value, VERIFICATIONS, 1, 1.0)


def provenance(kind: Column, verified: Column) -> Column:
    return source_kind(kind) * verification(verified)


def provenance_rank(kind: Column, verification: Column) -> Column:
    return _looked_up(kind, SOURCE_KINDS, 2, UNKNOWN_KIND_RANK) + _looked_up(verification, VERIFICATIONS, 2, UNKNOWN_VERIFICATION_RANK)


def procedural_safety(type_: Column, trust: Column, asks_guidance: Column) -> Column:
    """Guidance must come from procedures that are trusted."""
    procedural = type_ == "procedural"
    guided = F.when(~procedural, 0.82).when(trust == "trusted", 1.28).when(trust == "low", 0.35).when(trust == "untrusted", 0.12).otherwise(1.12)
    other = F.when(procedural & (trust == "untrusted"), 0.5).when(procedural & (trust == "low"), 0.72).otherwise(1.0)
    return F.when(asks_guidance, guided).otherwise(other)


def review_safety(status: Column, severity: Column, asks_guidance: Column) -> Column:
    """A review that is denied, pending or expired weighs against a row, most where guidance is asked for."""
    waiting = F.when(asks_guidance, F.lit(0.18) * F.when(severity == "critical", 0.8).when(severity == "medium", 1.35).otherwise(1.0)).otherwise(0.72)
    return F.when(status == "denied", F.when(asks_guidance, 0.03).otherwise(0.25)).when(status.isin("pending", "expired"), waiting).otherwise(1.0)


def category(value: Column, query: Column, hints: dict[str, list[str]] | None = None, boost: float = 1.3) -> Column:
    """A query that names the category, or one of its hints."""
    hit = (value != "") & F.contains(F.lower(query), F.lower(value))
    for name, words in (hints or {}).items():
        hit = hit | ((F.lower(value) == name) & reduce(lambda a, b: a | b, [F.contains(F.lower(query), F.lit(w)) for w in words]))
    return F.when(hit, boost).otherwise(1.0)


def authority(level: Column) -> Column:
    return _cases(level, AUTHORITY_WEIGHT, 1.0)


def authority_rank(level: Column) -> Column:
    return _cases(level, AUTHORITY_RANK, 0)


def rounded(score: Column, digits: int = 6) -> Column:
    """As SQL engines round doubles: by scaling, halves away from zero. Spark's own round() goes by the shortest decimal, which differs where that ends in a 5."""
    return F.round(score * F.lit(10.0**digits)) / F.lit(10.0**digits)


def composite(*factors: Column) -> Column:
    return reduce(lambda a, b: a * b, factors)


def effective_review(status: Column, required: Column, expires_at: Column, now: Column) -> Column:
    """Allowed but elapsed: expired. Required but undecided: pending."""
    return F.when((status == "allowed") & (expires_at <= now), "expired").when(status.isNull() & required, "pending").otherwise(status)
