"""Searches whose words are taken from texts agree with their SQL whatever these words are; scores round as SQL engines round."""

import duckdb
import pytest
from test_queries import rows

from tidepool.functions import scoring as sc
from tidepool.operators import variants
from tidepool.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts whose first words would signal something, were they a question's own."""
    path = str(tmp_path_factory.mktemp("named"))
    first = ["reserved duration", "currently previously", "production exclusive", "token labels", "credential outages", "secret recovery", "maintenance temporary", "supported workflow"]
    texts = [(i, f"{first[i // 20 % 8]} {first[i // 20 % 8]} more words number{i % 13} " + "and others " * (i % 7) if i % 20 in (0, 1, 2, 3, 6) else f"word{i % 5} other text {i}", "en", f"s{i % 3}") for i in range(960)]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", texts)
    con.execute(f"COPY d TO '{path}/documents.parquet'")
    return path


@pytest.mark.parametrize("name", ["multi_query_search", "query_context", "guided_search"])
def test_named_things_signal_nothing(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, folder)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found and found == rows(columns, want.fetchall())


def test_wording():
    plain, back = variants.wording("How is Reserved linked to unreserved, reserved?", ["reserved", "linked"])
    assert "eserved linked" not in plain and "unreserved" in plain
    assert back(plain) == "How is Reserved linked to unreserved, reserved?"
    assert variants.wording("How is it?", [])[0] == "How is it?"


def test_rounding_of_halves(spark):
    values = [k / 1e7 for k in range(5, 200_005, 10)] + [1.0000005 * k for k in range(1, 2000)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(sc.rounded(spark_col("v"))).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
