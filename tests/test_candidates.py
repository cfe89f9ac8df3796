"""Rows for reflection: each text is read a few times, however often its parts are used."""

import re

from pyspark.sql import functions as F

from tidepool.operators import answers, reflections

TEXTS = ["We prefer short", "prefer", "preference is late", "the preference is", "the preference", "-prefer x", "a decision stands", "Decided now", "we (decided) now", "plan b", " .. plan b", "a plan", "a plan, b", "unplan b", None, "", "  ",
    "!! One,two  (three) -- four. five six", "a", "...", "x:\r\n y", " First line here \r\nsecond", "Label one: Some longer words here. And more", "One two three four five: kept", "is it", "Relay node uses x", "caf\u00e9 pl\u00e1n b"]


def old_kind(text):
    said = re.sub("[^a-z0-9_-]+", " ", text.lower()).strip(" ")
    return "stable-preference" if re.search("(^| )prefer | preference ", said) else "stable-decision" if re.search("(^| )decision | decided | plan ", said) else "stable-fact"


def old_label(text):
    words = [w for w in (re.sub("^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+$", "", w) for w in re.split(r"\s+", text)) if w][:4]
    end = next((k for k, w in enumerate(words) if w.lower() in answers.LABEL_ENDS), len(words))
    return " ".join(words[:end]) or None


def test_parts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    got = rows.select("id", reflections.kind(F.lit("semantic"), F.col("t"), F.lit(None).cast("string")).alias("kind"), answers.subject_label(F.col("t")).alias("label")).collect()
    for r in got:
        if TEXTS[r.id] is not None:
            assert (r.kind, r.label) == (old_kind(TEXTS[r.id]), old_label(TEXTS[r.id])), TEXTS[r.id]


def test_summaries(spark):
    rows = spark.createDataFrame([("x:\r\n y",), (" First line here \r\nsecond",), ("Label one: Some longer words here. And more",), ("  ",), (None,)], "t string")
    assert [r[0] for r in rows.select(reflections.summary(F.col("t"), F.lit(None).cast("string"))).collect()] == [None, "First line here", "Some longer words here", None, None]


def test_the_plan_names_the_text_a_few_times(spark):
    # every use of a summary or key once copied all that it is made of, also into a filter at the source
    given = ["secret_class", "derived_kind", "knowledge_key", "knowledge_summary", "knowledge_kind", "review_status"]
    m = spark.range(3).select("id", F.lit("semantic").alias("memory_type"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("searchable_text"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"), F.lit("trusted").alias("source_trust"), F.lit("web").alias("source_kind"),
        F.lit("none").alias("source_verification"), F.lit(False).alias("review_required"), F.lit(None).cast("timestamp_ntz").alias("review_expires_at"), *[F.lit(None).cast("string").alias(c) for c in given])
    plan = reflections.candidates(m, F.lit("2024-01-01").cast("timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("searchable_text") < 30 and plan.count("split(") < 20
