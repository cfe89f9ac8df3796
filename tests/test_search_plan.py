"""Filters, reviews, authority, conflicts, reflections and rerank in the ranked search; labels of texts; variants of a query."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidepool.functions import labels
from tidepool.operators import policy, rank, retrieve, variants

NOW = "TIMESTAMP_NTZ'2024-03-01 00:00:00'"
COLUMNS = "id long, searchable_text string, memory_type string, importance int, created_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, source_trust string, source_kind string, source_verification string, source_chain string, category string, tier int, session string"
EDGES = "source_id long, target_id long, relation string, confidence double, valid_until timestamp_ntz"


def memory(i, text, kind="semantic", trust="normal", chain=None, category="a", tier=1, session=None):
    return (i, text, kind, 5, datetime(2024, 2, 1), None, None, trust, "other", "none", chain, category, tier, session)


def plan_of(spark, *rows, **more):
    """rows: (query, asks_guidance)."""
    plan = spark.createDataFrame([(n, q, "keyword-any", "neutral", "neutral", False, False, g) for n, (q, g) in enumerate(rows)], retrieve.PLAN)
    return plan.select("*", *[F.expr(v).alias(k) for k, v in more.items()])


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.memory_id)
    return out


@pytest.mark.parametrize(
    "text, scope, domains",
    [
        ("Restart the Production port", "production", ["networking"]),
        ("our lab token, api key", "lab", ["security"]),
        ("Ports and tokens alone are no whole words", "general", []),
        ("cutover during an outage", "production", ["maintenance"]),
        ("the startup path of the gpu-host", "general", ["runtime-ops", "deployment"]),
        ("a reset window", "maintenance", ["maintenance"]),
        (None, "general", []),
        ("", "general", []),
    ],
)
def test_labels(spark, text, scope, domains):
    got = spark.createDataFrame([(text,)], "t string").select(labels.scope(F.col("t")).alias("s"), F.coalesce(labels.domains(F.col("t")), F.array()).alias("d")).first()
    assert (got.s, got.d) == (scope, domains)


def test_fits(spark):
    rows = [("staging", "lab", True), ("production", "lab", False), ("general", "lab", True), (None, "lab", True), ("odd", "lab", True)]
    got = spark.createDataFrame(rows, "own string, asked string, want boolean").select(labels.scope_fits(F.col("own"), F.col("asked")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)
    rows = [("auth-bypass-exception", "Disable AUTH now", True), ("auth-bypass-exception", "auth", False), ("network-exposure-exception", "bind 0.0.0.0", True), ("network-exposure-exception", "bid 0a0b0c0", False), (None, "x", True), ("operational-exception", "x", True)]
    got = spark.createDataFrame(rows, "own string, q string, want boolean").select(labels.class_fits(F.col("own"), F.col("q")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_filters_and_tiers(spark):
    m = spark.createDataFrame([memory(1, "relay", category="a"), memory(2, "relay", category="b"), memory(3, "relay", kind="procedural"), memory(4, "relay", tier=0)], COLUMNS)
    none = spark.createDataFrame([], EDGES)
    plan = plan_of(spark, *[("relay", False)] * 6, category="CASE query_id WHEN 0 THEN 'a' WHEN 1 THEN 'b' END", memory_type="CASE query_id WHEN 0 THEN 'semantic' WHEN 2 THEN 'procedural' END", depth="CASE query_id WHEN 3 THEN 'standard' WHEN 4 THEN 'deep' WHEN 0 THEN 'forensic' END")
    got = {q: set(x) for q, x in lists(retrieve.retrieve(plan, m, none, F.expr(NOW))).items()}
    assert got == {0: {1, 4}, 1: {2}, 2: {3}, 3: {1, 2, 3}, 4: {1, 2, 3, 4}, 5: {1, 2, 3, 4}}


def test_empty_queries_find_nothing(spark):
    m = spark.createDataFrame([memory(1, "relay")], COLUMNS)
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "memory_id long, embedding array<double>")
    asked = spark.createDataFrame([(n, [1.0, 0.0]) for n in range(3)], "query_id long, embedding array<double>")
    plan = plan_of(spark, ("relay", False), ("  ", False), (None, False)).withColumn("mode", F.lit("auto"))
    assert set(lists(retrieve.retrieve(plan, m, spark.createDataFrame([], EDGES), F.expr(NOW), 3, vectors, asked))) == {0}


def test_reviews_bind_guidance(spark):
    m = spark.createDataFrame([memory(k, f"supported relay procedure {k}", "procedural") for k in range(1, 7)] + [memory(9, "relay procedure notes")], COLUMNS)
    later, past = datetime(2024, 5, 1), datetime(2024, 2, 2)
    reviews = spark.createDataFrame(
        [(2, True, "denied", None, "high", None, None), (3, True, None, None, "high", None, None), (4, True, "allowed", past, "high", None, None), (5, True, "allowed", later, "high", "staging", None), (6, True, "allowed", later, "high", None, "auth-bypass-exception")],
        "id long, review_required boolean, review_status string, review_expires_at timestamp_ntz, review_severity string, review_scope string, review_policy_class string",
    )
    plan = plan_of(spark, ("how do I use the relay procedure", True), ("relay procedure", False), ("how do I use the staging relay procedure without auth", True))
    got = {q: set(x) for q, x in lists(retrieve.retrieve(plan, m, spark.createDataFrame([], EDGES), F.expr(NOW), reviews=reviews)).items()}
    # 5's scope alone is no reason: only a class whose scope or words do not fit is
    assert got == {0: {1, 5, 9}, 1: {1, 2, 3, 4, 5, 6, 9}, 2: {1, 5, 6, 9}}


def test_authority_weighs_by_the_query_s_domains(spark):
    records = spark.createDataFrame([(1, "ops", "wiki"), (2, None, "wiki"), (3, "lab", None)], "memory_id long, source_chain string, source_kind string")
    registry = spark.createDataFrame([("networking", "chain", "ops", "authoritative"), ("networking", "kind", "wiki", "reference"), ("security", "chain", "lab", "primary")], "domain string, name string, value string, level string")
    by_domain = rank.authority_by_domain(records, registry)
    c = spark.createDataFrame([(q, m, t) for q, t in ((1, "which port"), (2, "which token"), (3, "which garden")) for m in (1, 2, 3)], "query_id long, memory_id long, query string")
    got = {(r.query_id, r.memory_id): r.authority for r in rank.authority_for(c, by_domain, labels.domains(F.col("query"))).collect()}
    assert got == {(1, 1): 100, (1, 2): 30, (1, 3): 0, (2, 1): 0, (2, 2): 0, (2, 3): 80, (3, 1): 0, (3, 2): 0, (3, 3): 0}


CONFLICT = "query_id long, memory_id long, score double, query string, asks_guidance boolean, memory_type string, searchable_text string, trust string, pending boolean, denied boolean, authority long, source_chain string, provenance_rank long, review_scope string, policy_class string"


def test_conflicts_in_two_rounds(spark):
    def row(q, m, text="relay", trust="trusted", authority=0, chain=None, kind="procedural", query="what is the supported relay path", denied=False, scope=None):
        return (q, m, 0.5, query, True, kind, text, trust, False, denied, authority, chain, 30, scope, None)

    rows = [
        *[row(1, 1, "the supported relay"), row(1, 2, "a temporary relay"), row(1, 3, kind="semantic"), row(1, 4, trust="low"), row(1, 5, "the supported relay", denied=True)],  # 1 is far above 2
        *[row(2, 1), row(2, 2)],  # alike: both stay
        *[row(3, 1, authority=80, chain="a"), row(3, 2, "the supported relay", authority=80, chain="a"), row(3, 3, "the supported relay", authority=30, chain="b"), row(3, 4)],  # of chain a one is above; others are not compared
        *[row(4, 1, authority=80, chain="a"), row(4, 2, "the supported relay", authority=80, chain="b")],  # no chain leads: all are compared
        *[row(5, 1, query="which relay"), row(5, 2, "the supported relay", query="which relay")],  # no focus
        *[row(6, 1, trust="normal"), row(6, 2)],  # a hundred by trust
        *[row(7, 1, query="supported staging path", scope="staging"), row(7, 2, query="supported staging path", scope="production")],
    ]
    got = {}
    for r in policy.resolve_conflicts(spark.createDataFrame(rows, CONFLICT)).collect():
        got.setdefault(r.query_id, set()).add(r.memory_id)
    assert got == {1: {1, 3, 4, 5}, 2: {1, 2}, 3: {2, 3, 4}, 4: {2}, 5: {1, 2}, 6: {2}, 7: {1}}


def test_reflections_and_rerank(spark):
    m = spark.createDataFrame([memory(k, "relay " * k) for k in range(1, 6)], COLUMNS)
    derived = spark.createDataFrame([(1, "reflection", "current"), (2, "Reflection", "superseded"), (3, "reflection", "contested")], "memory_id long, derived_kind string, reflection_status string")
    plan = plan_of(spark, *[("relay", False)] * 4, reflection="element_at(array('neutral', 'only-current', 'prefer-current', 'prefer-source'), CAST(query_id + 1 AS INT))")
    found = lambda **o: lists(retrieve.retrieve(plan_of(spark, *[("relay", False)] * 4, **o.pop("plan", {})), m, spark.createDataFrame([], EDGES), F.expr(NOW), **o))
    got = lists(retrieve.retrieve(plan, m, spark.createDataFrame([], EDGES), F.expr(NOW), derived=derived))
    assert set(got[1]) == {1, 3} and set(got[2][:2]) == {1, 3} and got[2][-1] == 2
    assert set(got[3][:2]) == {4, 5} and got[3][-1] == 2 and sorted(got[0]) == [1, 2, 3, 4, 5]
    short = lambda text, query, score: 100.0 - F.length(text)
    assert found(plan={"rerank_limit": "5"}, reranker=short)[0] == [1, 2, 3, 4, 5]
    plain = found()[0]
    assert found(plan={"rerank_limit": "1"}, reranker=short)[0] == plain  # its best row stays first
    assert found(scoring=lambda now, guidance: F.lit(1.0) * F.col("memory_id"))[0][0] == 5


@pytest.mark.parametrize(
    "query, want",
    [
        ("relay", [("relay", 1.0)]),
        ("what is the relay", [("what is the relay", 1.0), ("relay", 1.0)]),
        ("How is the relay linked to beta?", [("How is the relay linked to beta?", 1.0), ("relay linked beta?", 1.0), ("relay beta", 1.35)]),
        ("how do I start the relay", [("how do I start the relay", 1.0)]),
        ("", [("", 1.0)]),
    ],
)
def test_variants(query, want):
    assert variants.variants_of(query) == want


def test_frontiers_keep_the_best_product(spark):
    edges = [(1, 2, "caused_by"), (1, 3, "depends_on"), (3, 2, "superseded_by"), (2, 4, "related_to"), (4, 1, "superseded_by"), (5, 4, "superseded_by"), (2, 2, "superseded_by")]
    relations = spark.createDataFrame([(a, b, r, 1.0, None) for a, b, r in edges] + [(1, 9, "superseded_by", 1.0, datetime(2024, 1, 1))], EDGES)
    seeds = spark.createDataFrame([(1, 1, 1.0, 3), (1, 5, 0.4, 3), (2, 1, 1.0, 1), (3, 77, 1.0, 2)], "query_id long, memory_id long, score double, levels int")
    got = {}
    for r in variants.expand(seeds, relations, F.expr(NOW)).collect():
        got[r.query_id, r.memory_id] = max(r.score, got.get((r.query_id, r.memory_id), 0))
    weight = lambda r: variants.RELATION_WEIGHTS.get(r, variants.OTHER_RELATION)

    def walk(node, depth, most):
        for a, b, r in edges:
            if a == node and depth < most:
                yield b, depth + 1, r
                yield from walk(b, depth + 1, most)

    want = {}
    for q, seed, score, most in seeds.collect():
        for node, depth, r in walk(seed, 0, most):
            want[q, node] = max(want.get((q, node), 0), score / (depth + 1) * weight(r))
    want = {k: v for k, v in want.items() if k[1] not in (1, 5)}  # a seed's own score is above what leads back to it
    assert {k: v for k, v in got.items() if k[1] not in (1, 5)} == pytest.approx(want)


def test_search_in_variants(spark):
    m = spark.createDataFrame([memory(1, "relay beta one", session="s"), memory(2, "something new", session="s"), memory(3, "relay beta", session="t"), memory(4, "far away")], COLUMNS)
    relations = spark.createDataFrame([(1, 2, "superseded_by", 1.0, None), (2, 4, "related_to", 1.0, None)], EDGES)
    asked = spark.createDataFrame([(1, "How is relay linked to beta?"), (2, "How is the current relay linked to beta?"), (3, "relay beta"), (4, None)], "query_id long, query string")
    got = lists(variants.search(asked, m, relations, F.expr(NOW), variants.Assembly(max_per_session=0)))
    assert set(got[1]) == {1, 2, 3, 4} and set(got[3]) == {1, 3} and 4 not in got
    assert got[2].index(2) < got[2].index(1)  # superseded
    single = lists(variants.search(asked, m, relations, F.expr(NOW)))
    assert all(not {1, 2} <= set(x) for x in single.values())
    found = variants.search(asked, m, relations, F.expr(NOW), variants.Assembly(max_per_session=0))
    context = {r.query_id: r for r in variants.assemble_context(found, m, 5).collect()}
    assert context[1].truncated and context[1].used_tokens <= 5 and context[3].n_items == 1
