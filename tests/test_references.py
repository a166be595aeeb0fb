"""Orphan references against a plain scan of all intervals."""

import datetime as dt
import random

from vellum.operators.rank import earliest, group_rank
from vellum.operators.references import Edge, cascade, orphans, validity


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_against_all_intervals(spark):
    rng = random.Random(3)
    parents = [(rng.choice(["a", " A ", "b", "c", None, ""]), rng.choice([None, *range(20)]), rng.choice([None, *range(20)])) for _ in range(40)]
    children = [(i, rng.choice(["a", "B ", "c", "zz", "", "  ", None]), rng.choice([None, *range(20)])) for i in range(200)]
    p = spark.createDataFrame([(k, day(s), day(e)) for k, s, e in parents], "k string, s timestamp, e timestamp")
    c = spark.createDataFrame([(i, k, day(t), "x") for i, k, t in children], "id int, ref string, at timestamp, spans string").drop("spans")
    got = {r["row_key"]: r["reason"] for r in orphans(c, "id", {"ref": validity(p, "k", "s", "e")}, "at").collect()}
    key = lambda k: (k or "").strip().upper()
    spans = [(key(k), s, e) for k, s, e in parents if key(k) and s is not None and (e is None or e > s)]
    want = {i for i, k, t in children if key(k) and not any(q == key(k) and t is not None and s <= t and (e is None or e > t) for q, s, e in spans)}
    assert set(got) == want
    assert all(got[i] == "absent" for i, k, t in children if i in want and not any(q == key(k) for q, _, _ in spans))


def test_empty_tables(spark):
    p = spark.createDataFrame([], "k string, s timestamp, e timestamp")
    c = spark.createDataFrame([(1, "a", day(1))], "id int, ref string, at timestamp")
    assert orphans(c, "id", {"ref": validity(p, "k", "s", "e")}, "at").count() == 1
    assert orphans(c.limit(0), "id", {"ref": validity(p, "k", "s", "e")}, "at").count() == 0


def test_cascade_on_a_cycle(spark):
    rows = spark.createDataFrame([("2", "1"), ("3", "2"), ("1", "3"), ("9", "8")], "key string, ref string")
    direct = spark.createDataFrame([("t", "1")], "table_name string, row_key string")
    got = {(r["row_key"], r["depth"]) for r in cascade(direct, [Edge("t", "t", rows)]).collect()}
    assert got == {("1", 0), ("2", 1), ("3", 2)}
    assert cascade(direct.limit(0), [Edge("t", "t", rows)]).count() == 0


def test_earliest(spark):
    rows = [(1, day(3), "late"), (1, day(1), "early"), (1, None, "never"), (2, None, None), (None, day(1), "n")]
    got = {r["id"]: r["v"] for r in earliest(spark.createDataFrame(rows, "id int, at timestamp, v string"), "id", "at", "v").collect()}
    assert got == {1: "early", 2: None, None: "n"}


def test_group_rank(spark):
    rows = [("hot" if i % 3 else None if i % 9 else "b", i) for i in range(500)]
    got = group_rank(spark.createDataFrame(rows, "k string, i int"), "k", ["i"]).collect()
    for k in ("hot", None, "b"):
        ranks = sorted(r["rank"] for r in got if r["k"] == k)
        assert ranks == list(range(len(ranks)))
    assert len(got) == 500
