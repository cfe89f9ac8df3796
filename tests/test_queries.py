"""Each query against its SQL, on the smallest tables."""

import os
from datetime import datetime

import duckdb
import pytest

from tidepool.plans.route import Query, expand_dates, route
from tidepool.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(v[k], 5) if isinstance(v[k], float) else v[k] for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_routes(spark):
    assert QUERIES["query_routes"](spark, SF).count() == 40


@pytest.mark.parametrize(
    "query, intent",
    [
        ("How many sessions failed?", "aggregation"),
        ("Did we ever mention a relay?", "abstention-risk"),
        ("What is the supported startup workflow?", "stable-summary"),
        ("What exact version was removed?", "exact-detail"),
        ("What was used previously?", "historical-state"),
        ("What is the latest plan?", "current-state"),
        ("Tell me about gardens", "general"),
        ("What was the second model tried?", "exact-detail"),
        ("Which was the third candidate?", "exact-detail"),
        ("Which first step helped?", "exact-detail"),
        ("The first garden was green", "general"),
    ],
)
def test_intents(query, intent):
    assert Query(query).intent == intent


def test_route_of_a_count():
    r = route("How many sessions failed?")
    assert (r.mode, r.depth, r.rerank_limit, r.alignment) == ("exhaustive", "deep", 0, False)


def test_dates():
    now = datetime(2024, 3, 1)
    assert expand_dates("notes from last week please", now) == ("notes from please", datetime(2024, 2, 23), None)
    assert expand_dates("plain", now) == ("plain", None, None)
