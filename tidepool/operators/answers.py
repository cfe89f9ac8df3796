"""Answers from the evidence of many queries at once: the rows that count for a query become one bounded array, and a ladder of
conditions over it picks kind, text, confidence and reason. Secrets in an answer are masked by this engine's own rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators.grounding import grounded
from tidepool.plans.route import Query

# The answers that abstain, wording that denies or renews a state, wording that a detail is missing.
NOTHING = "I don’t have enough grounded evidence to answer."
NOT_EXACTLY = "I don’t have enough grounded evidence to answer that exactly."
NO_DETAIL = "I don’t have the exact grounded detail needed to answer that."
NO_SECRETS = "I won't surface secret or credential material from memory."
NEGATIVE = ["superseded", "retired", "revoked", "deprecated", "no longer", "not active", "not directly", "obsolete", "replaced", "rather than", "instead", "outdated", "expired", "return to", "did not", "do not", "should not", "cannot", "can not"]
RENEWED = ["current ", "currently ", "right now", "use ", "uses ", "keep ", "keeps ", "restore ", "restores ", "rather than", "instead"]
LACKING = ["not recorded", "never recorded", "not documented", "never documented", "not captured", "unknown"]
NUMBERS = "Zero One Two Three Four Five Six Seven Eight Nine Ten".split()
LABEL_ENDS = "was were is are supports support remains remain evaluated recorded covers cover includes include validated should can cannot did does used use".split()
TRUST_RANK = {"trusted": 400, "normal": 320, "low": 120, "untrusted": 0}
#: What is masked, by what, in this order: whole blocks before their parts.
REDACTIONS = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(-----END [A-Z ]*PRIVATE KEY-----|$)", "[REDACTED_KEY]"),
    (r"(?i)\b([A-Z0-9_]*(?:key|token|secret|password|passwd))(\s*[=:]\s*)[^\s,;]+", "$1$2[REDACTED_SECRET]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{8,}=*", "Bearer [REDACTED_SECRET]"),
    (r"\b(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{8,}", "[REDACTED_SECRET]"),
    (r"\bAKIA[A-Z0-9]{12,}", "[REDACTED_SECRET]"),
    (r"\b(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)(?:\.[0-9]{1,3}){2,3}(?:/[0-9]{1,2})?", "[REDACTED_NETWORK]"),
    (r"\\\\[A-Za-z0-9._-]+\\[^\s,;]+", "[REDACTED_PATH]"),
    (r"(?<![\w/])(?:smb|nfs)://[^\s,;]+", "[REDACTED_PATH]"),
]

FEATURES = "query_id long, query string, intent string, strict boolean, together boolean, yes_no boolean, secret_value boolean, applies_now boolean, lists boolean, guidance boolean, literals array<string>"


def redact(text: Column) -> Column:
    """Secrets, private addresses and share paths replaced by what they are; other text stays. Null stays null."""
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def says(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return F.greatest(*[F.contains(low, F.lit(p)) for p in phrases])


#: A text up to the end of its fourth word, so that no more of it is split.
_FOUR_WORDS = r"^(?:[^A-Za-z0-9_-]*+(?>[A-Za-z0-9_-](?:\S*[A-Za-z0-9_-])?)){0,4}"


def subject_label(text: Column) -> Column:
    """The first words, at most four, up to a word that says something of them; else null."""
    words = F.transform(F.split(F.regexp_extract(text, _FOUR_WORDS, 0), r"\s+"), lambda w: F.regexp_replace(w, "^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+$", ""))
    first = F.slice(F.filter(words, lambda w: w != ""), 1, 4)
    end = F.array_position(F.transform(first, lambda w: F.lower(w).isin(LABEL_ENDS)), True)
    kept = F.when(end > 0, F.slice(first, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(first)
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def selection_rank(trust: Column, authority: Column, provenance: Column) -> Column:
    """What speaks for a row beside its score. trust: a level's name."""
    out = F.lit(TRUST_RANK["normal"])
    for level, worth in TRUST_RANK.items():
        out = F.when(trust == level, worth).otherwise(out)
    return (out + F.coalesce(authority, F.lit(0)) + F.coalesce(provenance, F.lit(0))).cast("long")


def features(queries: DataFrame) -> DataFrame:
    """What each query asks for; one small row a query."""

    def literals(query: str) -> list[str]:
        words = [w.strip("\"'`,;:!?()[]{}<>*=&%$#@|^~+\\") for w in query.lower().split()]
        return [w for w in words if len(w) >= 3 and any(c.isdigit() or c in "./_-" for c in w)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["query_id"], b["query"], strict=True):
                q = Query(text or "")
                lists = bool(q.pairs & {("how", "many"), ("list", "all"), ("which", "ones")}) or "what were they" in q.text
                rows.append((key, text or "", q.intent, q.strict, q.together, q.yes_no, q.secret_value, q.applies_now, lists, q.guidance, literals(text or "")))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return queries.select("query_id", "query").mapInPandas(run, FEATURES)


def distinct_rows(evidence: DataFrame, most: int) -> DataFrame:
    """Of each query the best row of each normal form of a text, and of these the best so many. An empty normal form is no evidence."""
    best = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(F.col("score").desc(), "memory_id"))
    kept = evidence.withColumn("_key", tx.normalize(F.col("text"))).where("_key != ''").withColumn("_b", best).where("_b = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id"))
    return kept.withColumn("_place", place).where(F.col("_place") <= most)


def compose(evidence: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """query_id, answer, kind, confidence, abstained, rationale, n_evidence: one row a query, without evidence too.
    evidence: query_id, memory_id, text, score, rank (see selection_rank); queries: query_id, query. Ties go to the smaller memory_id."""
    row = F.struct("_place", "memory_id", "text", "score", F.col("rank").cast("long").alias("rank"), says(F.col("text"), NEGATIVE).alias("negative"), says(F.col("text"), RENEWED).alias("renewed"), subject_label(F.col("text")).alias("label"))
    lists = distinct_rows(evidence, most).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("ev"))
    both = features(queries).join(lists, "query_id", "left")
    q, ev = F.lower("query"), F.col("ev")

    def worth(x: Column) -> Column:
        stale = F.col("applies_now") & ~F.col("yes_no") & x["negative"] & ~x["renewed"]
        return F.greatest(x["rank"] - F.when(stale, 220).otherwise(0), F.lit(0)).cast("long")

    def denied(x: Column) -> Column:
        low = F.lower(x["text"])
        bound = F.contains(q, F.lit("0.0.0.0")) & F.contains(low, F.lit("127.0.0.1"))
        behind = F.contains(q, F.lit("without auth")) & F.greatest(*[F.contains(low, F.lit(p)) for p in ("127.0.0.1", "behind the audited tunnel", "keep the")])
        return x["negative"] | bound | behind

    def first_by(rows: Column, *keys) -> Column:
        """The row with the greatest keys; the place decides ties."""
        ordered = F.transform(rows, lambda x: F.struct(*[(-k(x)).alias(f"k{n}") for n, k in enumerate(keys)], x["_place"].alias("p"), x.alias("x")))
        return F.get(F.array_sort(ordered), F.lit(0))["x"]

    named = lambda x: F.size(F.filter("literals", lambda w: F.contains(F.lower(x["text"]), w)))
    score = lambda x: x["score"]
    best = F.when(F.col("guidance"), first_by(ev, worth, score)).otherwise(F.get(ev, F.lit(0)))
    literal = first_by(ev, named, score)
    both = both.withColumn("n", F.coalesce(F.when(ev.isNotNull(), F.size("ev")), F.lit(0))).withColumn("best", best).withColumn("literal", literal)
    against = F.when(F.col("applies_now"), first_by(F.filter(ev, denied), worth, score))
    chosen = F.coalesce(against, F.when(named(F.col("literal")) > 0, F.col("literal")), F.col("best"))
    both = both.withColumn("chosen", chosen)

    first, second = F.get(ev, F.lit(0)), F.get(ev, F.lit(1))
    unsure = F.coalesce((first["negative"] != second["negative"]) & (second["score"] >= first["score"] * 0.6), F.lit(False))
    lacks = F.col("strict") & F.exists(ev, lambda x: F.greatest(*[F.contains(tx.normalize(x["text"]), F.lit(p)) for p in LACKING]))
    has_ground = grounded(F.col("query"), F.col("best")["text"], F.col("strict"), F.col("together"), F.col("yes_no"))
    labels = F.filter(F.transform(ev, lambda x: x["label"]), lambda x: x.isNotNull())
    rolled = F.col("lists") & (F.size(labels) == F.col("n"))
    count = F.coalesce(F.get(F.lit(NUMBERS), F.col("n")), F.col("n").cast("string"))
    joined = F.array_join(F.transform(ev, lambda x: F.trim(x["text"])), " ")
    text = lambda name: F.trim(F.col(name)["text"])

    def said(answer, kind: str, confidence, rationale, abstained: bool = False) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(lit(answer).alias("answer"), F.lit(kind).alias("kind"), lit(confidence).alias("confidence"), F.lit(abstained).alias("abstained"), lit(rationale).alias("rationale"))

    agreed, why = F.when(unsure, "medium").otherwise("high"), lambda reason: F.when(unsure, "conflicting-state-evidence").otherwise(reason)
    rollup, none = F.col("intent") == "aggregation", F.col("n") == 0
    ladder = [
        (rollup & none, said(NOTHING, "aggregation", "low", "no-supporting-evidence", True)),
        (rollup & rolled, said(F.concat(count, F.lit(" items: "), F.array_join(labels, ", "), F.lit(".")), "aggregation", F.when(F.col("n") >= 2, "high").otherwise("medium"), "distinct-rollup")),
        (rollup, said(joined, "aggregation", "medium", "joined-evidence")),
        (F.col("secret_value"), said(NO_SECRETS, "abstain", "low", "sensitive-secret-detail", True)),
        (none, said(NOTHING, "abstain", "low", "no-supporting-evidence", True)),
        (lacks, said(NO_DETAIL, "abstain", "low", "unsupported-detail", True)),
        (F.col("strict") & ~F.col("yes_no") & ~has_ground, said(NOT_EXACTLY, "abstain", "low", "insufficient-grounding", True)),
        (F.col("yes_no"), said(F.concat(F.when(denied(F.col("chosen")), "No. ").otherwise("Yes. "), text("chosen")), "yes-no", agreed, why("stateful-polarity"))),
        (F.col("intent").isin("current-state", "historical-state", "stable-summary"), said(text("best"), "stateful", agreed, why("stateful-route"))),
        (F.col("strict"), said(text("best"), "direct", "high", "grounded-detail")),
    ]
    out = said(text("best"), "direct", "medium", "top-evidence")
    for condition, answer in reversed(ladder):
        out = F.when(condition, answer).otherwise(out)
    return both.select("query_id", F.col("n").cast("long").alias("n_evidence"), out.alias("a")).select("query_id", redact(F.col("a.answer")).alias("answer"), "a.kind", "a.confidence", "a.abstained", "a.rationale", "n_evidence")
