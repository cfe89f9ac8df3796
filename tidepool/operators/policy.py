"""What a candidate list may hold and in which order: procedures that are safe to follow, and derived rows against their sources.

A candidate list has query_id, memory_id, score; what else a function reads is named there. A list is what a search has let through, so
a query's window is bounded by its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import labels

#: Preference: factors of current, superseded and other rows, and their buckets; the greater bucket comes first.
PREFERENCES = {
    "neutral": ((1.0, 1.0, 1.0), (2, 0, 1)),
    "only-current": ((1.0, 1.0, 1.0), (2, 0, 1)),
    "prefer-current": ((1.5, 0.5, 1.0), (2, 0, 1)),
    "prefer-source": ((0.7, 0.45, 1.15), (1, 0, 2)),
}


def _is(name: str, default: bool = False) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def isolate(candidates: DataFrame) -> DataFrame:
    """Where guidance is asked for and there are two rows or more, denied procedures go, and those whose policy class or its scope does not
    fit; where a safe one is left, so do pending ones and those of little trust. candidates: with asks_guidance, memory_type, trust (a
    level), pending, denied, policy_class, scope_fits, class_fits. A null flag is false, but a null fit fits; a null level is normal."""
    w = Window.partitionBy("query_id")
    fits = _is("scope_fits", True) & _is("class_fits", True)
    procedure = F.coalesce(F.col("memory_type") == "procedural", F.lit(False))
    trusted = F.coalesce(F.col("trust"), F.lit("normal")).isin("trusted", "normal")
    safe = procedure & trusted & ~_is("pending") & ~_is("denied") & fits
    has_safe = F.max(safe).over(w)
    gone = _is("denied") | (F.col("policy_class").isNotNull() & ~fits) | (has_safe & (~trusted | _is("pending")))
    bound = _is("asks_guidance") & (F.count(F.lit(1)).over(w) > 1) & procedure
    return candidates.withColumn("_gone", bound & gone).where("NOT _gone").drop("_gone")


def prefer_reflections(candidates: DataFrame, preference: str = "neutral") -> DataFrame:
    """Weighs derived rows against others and adds rank. candidates: with derived_kind and reflection_status; a derived row without a
    status is current, a contested one counts as current. Ties: the current row, then the smaller memory_id."""
    factors, buckets = PREFERENCES[preference]
    derived = F.coalesce(F.lower("derived_kind") == "reflection", F.lit(False))
    status = F.lower(F.coalesce("reflection_status", F.lit("current")))
    current, superseded = derived & status.isin("current", "contested"), derived & (status == "superseded")
    pick = lambda of: F.when(current, of[0]).when(superseded, of[1]).otherwise(of[2])
    rows = candidates.where(current) if preference == "only-current" else candidates
    weighed = rows.withColumn("score", F.col("score") * pick(factors)).withColumn("_current", current).withColumn("_bucket", pick(buckets))
    order = Window.partitionBy("query_id").orderBy(F.col("_bucket").desc(), F.col("score").desc(), F.col("_current").desc(), "memory_id")
    return weighed.withColumn("rank", F.row_number().over(order)).drop("_bucket", "_current")


# What makes a query or a procedure speak of the default or of an exception, and the weights of the rank.
FOCUS = ["supported", "approved", "normally", "normal ", "breakglass", "outage", "temporary procedure"]
ASKS_EXCEPTION = ["breakglass", "outage", "temporary", "recovery"]
ASKS_HIGH_IMPACT = [*ASKS_EXCEPTION, "without auth", "disable auth", "bypass auth", "reset window", "maintenance reset", "rebuild from scratch", "destructive procedure", "cutover", "switch clients", "redirect traffic"]
ASKS_DEFAULT = ["supported", "approved", "normally", "normal "]
IS_DEFAULT = ["supported", "normal production path", "keep the", "scheduled task"]
IS_EXCEPTION = ["temporary", "breakglass", "workaround", "older", "until", "without auth", "disable auth", "rebuild from scratch", "drop the", "cutover", "switch clients", "redirect traffic"]
#: Scope of the query: what the text has to say for the first weight, and what for the second.
PLACES = [(("staging", "lab"), "staging|lab", 160, "production", -180), (("production",), "production", 120, "staging|lab", -140), (("migration",), "migration|bridge", 120, "production", -80)]
LEAD = 15


#: What of a procedure's text conflict_rank() asks for.
SHOWN = list(dict.fromkeys([p for _, first, _, second, _ in PLACES for p in (first, second)] + [labels.any_of(IS_DEFAULT), labels.any_of(IS_EXCEPTION)]))


def shows(text: Column) -> Column:
    """Which of SHOWN a text has, as booleans: all that conflict_rank() reads of it, so that the text need not go where it is read."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[low.rlike(p) for p in SHOWN])


def may_conflict(memory_type: Column, trust: Column) -> Column:
    """Whether a row's own columns let it be one of several procedures that contradict each other."""
    return (memory_type == "procedural") & trust.isin("trusted", "normal")


def conflict_rank(query: Column, shown: Column, score: Column) -> Column:
    """How well a trusted procedure answers a query for one. shown: see shows(). Reads trust, authority, provenance_rank, review_scope and policy_class of the row."""
    q, asked = F.lower(query), labels.scope(query)
    says = lambda c, phrases: c.rlike(labels.any_of(phrases))
    has = lambda pattern: shown[SHOWN.index(pattern)]
    own = F.col("review_scope")
    exception, high = says(q, ASKS_EXCEPTION), says(q, ASKS_HIGH_IMPACT)
    default = ~exception & says(q, ASKS_DEFAULT)
    rank = F.when(F.col("trust") == "trusted", 400).otherwise(300) + F.coalesce("authority", F.lit(0)) + F.col("provenance_rank") + (score * 100).cast("int")
    rank += F.when(labels.scope_fits(own, asked), 15).otherwise(0) + F.when(labels.class_fits(F.col("policy_class"), query), 15).otherwise(0)
    rank += F.when((own == asked) & (own != "general"), 140).when(own.isNotNull() & (own != "general"), -120).when(own.isNull() & (asked != "general"), -35).otherwise(0)
    for scopes, first, up, second, down in PLACES:
        rank += F.when(asked.isin(*scopes), F.when(has(first), up).when(has(second), down).otherwise(0)).otherwise(0)
    for asks, phrases, weight in ((default, IS_DEFAULT, 120), (default, IS_EXCEPTION, -160), (high, IS_EXCEPTION, 140), (high, IS_DEFAULT, -120)):
        rank += F.when(asks & has(labels.any_of(phrases)), weight).otherwise(0)
    return rank.cast("long")


def resolve_conflicts(candidates: DataFrame) -> DataFrame:
    """Where a query asks for the supported or exceptional way and several trusted procedures answer, the best one is left of them if it leads clearly, in two rounds: if
    one source chain has more authority than every other, only its procedures are compared; of these the first stays alone if its rank is more than LEAD
    above the second's. Other rows stay. candidates: with query, asks_guidance, memory_type, searchable_text (or shows, what shows() says of it), trust, pending, denied, authority (for the
    query's domains), source_chain, provenance_rank, review_scope, policy_class."""
    focused = F.lower("query").rlike(labels.any_of(FOCUS))
    eligible = _is("asks_guidance") & focused & may_conflict(F.col("memory_type"), F.col("trust")) & ~_is("pending") & ~_is("denied")
    rows = candidates.withColumn("_in", F.coalesce(eligible & (F.count(F.lit(1)).over(Window.partitionBy("query_id")) > 1), F.lit(False)))
    rows = rows.withColumn("_rank", F.when(F.col("_in"), conflict_rank(F.col("query"), F.col("shows") if "shows" in candidates.columns else shows(F.col("searchable_text")), F.col("score"))))
    # first round: chains by authority, then rank; a chain's figures are those of its best rows
    chain = F.when(F.col("_in"), F.col("source_chain"))
    of_chain, of_query = Window.partitionBy("query_id", chain), Window.partitionBy("query_id")
    rows = rows.withColumn("_power", F.when(chain.isNotNull(), F.max(F.coalesce("authority", F.lit(0))).over(of_chain)))
    top_power = F.max("_power").over(of_query)
    leaders = F.size(F.collect_set(F.when(F.col("_power") == top_power, chain)).over(of_query))  # chains with the greatest authority: a list's chains at most
    leads = F.coalesce((top_power > 0) & (leaders == 1), F.lit(False))
    rows = rows.withColumn("_in", F.col("_in") & (~leads | F.coalesce(chain.isNotNull() & (F.col("_power") == top_power), F.lit(False))))
    # second round
    order = Window.partitionBy("query_id").orderBy(F.col("_in").desc(), F.col("_rank").desc(), "memory_id")
    rows = rows.withColumn("_place", F.row_number().over(order)).withColumn("_n", F.sum(F.col("_in").cast("int")).over(of_query))
    first, second = (F.max(F.when(F.col("_in") & (F.col("_place") == k), F.col("_rank"))).over(of_query) for k in (1, 2))
    gone = F.col("_in") & (F.col("_place") > 1) & (F.col("_n") > 1) & (first > second + LEAD)
    return rows.withColumn("_gone", F.coalesce(gone, F.lit(False))).where("NOT _gone").drop("_in", "_rank", "_power", "_place", "_n", "_gone")


def weigh_reflections(candidates: DataFrame, preference: Column) -> DataFrame:
    """prefer_reflections() with a preference for each row's query, and without rank: adds _bucket and _current for the last sort. Rows of queries that are neutral are as
    they were."""
    derived = F.coalesce(F.lower("derived_kind") == "reflection", F.lit(False))
    status = F.lower(F.coalesce("reflection_status", F.lit("current")))
    current, superseded = derived & status.isin("current", "contested"), derived & (status == "superseded")
    factor, bucket = F.lit(1.0), F.lit(0)
    for name, (factors, buckets) in PREFERENCES.items():
        if name != "neutral":
            pick = lambda of: F.when(current, of[0]).when(superseded, of[1]).otherwise(of[2])
            factor, bucket = F.when(preference == name, pick(factors)).otherwise(factor), F.when(preference == name, pick(buckets)).otherwise(bucket)
    kept = candidates.where(current | ~F.coalesce(preference == "only-current", F.lit(False)))
    return kept.withColumn("score", F.col("score") * factor).withColumn("_bucket", bucket).withColumn("_current", current)
