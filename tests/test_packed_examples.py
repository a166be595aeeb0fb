"""The learning queries read examples that are written once in blocks, never as a row a feature."""

import os
import random

import pytest

import __spark_entry__ as entry
from vellum.operators import features
from vellum.plans import learning

FOLDER = "/root/testdata/sf0.001"


def test_models_are_no_table_of_the_driver(spark, monkeypatch):
    """Weights leave the driver as arrays, and the examples' classes are those of the table of weights."""
    rng = random.Random(3)
    rows = [(i, f"f{rng.randrange(300)}" if k else f"s{i % 3}", rng.choice((1.0, 0.5)), "abc"[i % 3] if rng.random() < 0.8 else "a", i % 4) for i in range(400) for k in range(4)]
    df = spark.createDataFrame(rows, "id int, feature string, value double, label string, fold int")
    p = features.packed(features.by_example(df, 4))

    def refused(*a, **k):
        raise AssertionError("a table from the driver's rows")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    w, got = features.one_vs_rest(p, 4), features.classified(p, 4)
    monkeypatch.undo()
    # a feature that an example has twice counts as its sum, as in the join with the table of weights
    want = {r["id"]: (r["class"], r["probability"]) for r in features.applied(df.select("id", "fold", "feature", "value"), w).collect()}
    mine = {r["id"]: (r["class"], r["probability"]) for r in got.collect()}
    assert len(mine) == 400 and mine.keys() == want.keys()
    assert all(mine[k][0] == want[k][0] and mine[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in mine)


def ran(spark, monkeypatch, name):
    def refused(*a, **k):
        raise AssertionError("a row a feature")

    monkeypatch.setattr(learning, "feature_groups", refused)
    monkeypatch.setattr(features, "applied", refused)
    return entry.queries()[name](spark, FOLDER).collect()


needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@needs_data
def test_f14_learned(spark, monkeypatch):
    rows = ran(spark, monkeypatch, "f14_learned")
    assert rows and all(r["relation"] != "NENHUMA" and 0 < r["score"] <= 1 for r in rows)


@needs_data
def test_f9_weights(spark, monkeypatch):
    rows = ran(spark, monkeypatch, "f9_weights")
    names = {r["feature"] for r in rows}
    assert {"(bias)", "llr_max", "distancia:0"} <= names and len({r["class"] for r in rows}) > 2


@needs_data
def test_v7_weakly_supervised(spark, monkeypatch):
    (r,) = ran(spark, monkeypatch, "v7_weakly_supervised")
    assert r["agree"] + r["recovered"] + r["lost"] + r["false_removed"] + r["false_new"] == 1000


@needs_data
def test_f11_variants(spark, monkeypatch):
    rows = ran(spark, monkeypatch, "f11_variants")
    assert {r["variant"] for r in rows} == set(learning.VARIANTS)
    assert {sum(r["n"] for r in rows if r["variant"] == v) for v in learning.VARIANTS} == {1000}
