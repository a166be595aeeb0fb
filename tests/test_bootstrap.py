"""The bootstrap interval in all the draws of the survey."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_ten_thousand_draws(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW relations AS SELECT * FROM '{FOLDER}/relations.parquet'")
    sql = entry.oracle_sql()["v8_interval"]
    assert "range(10000)" in sql and "200" not in sql
    want = con.execute(sql).fetchone()
    got = entry.queries()["v8_interval"](spark, FOLDER).first()
    assert tuple(round(v, 5) for v in got) == tuple(round(v, 5) for v in want)


def test_draws_are_the_hash_of_the_sql():
    import hashlib

    from vellum.operators import evaluate

    for b in (0, 42, 9999, 12345678):
        for first, last in ((0, 10), (10, 100), (100, 140), (99990, 100000), (1000000, 1000020)):
            for n in (1, 97, 7654321):
                want = [int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:12], 16) % n for i in range(first, last)]
                assert evaluate.drawn(b, first, last, n).tolist() == want


def test_no_draw_is_a_row(spark):
    """The rows that reach the sum are the rounds, not rounds times cases, and large counts keep their value."""
    from vellum.operators import evaluate

    c = spark.createDataFrame([(f"{i:04}", 300 + i, 1, 2, i, 1, 2**40 if i == 7 else 0) for i in range(900)], "case_id string, a_tp int, a_fp int, a_fn int, b_tp int, b_fp int, b_fn bigint")
    df = evaluate.bootstrap(c, 20)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Generate" not in plan
    got = df.first()
    assert got["low"] < 0 < got["high"] <= 1
    assert evaluate.bootstrap(c.limit(0), 20).first()["low"] is None
