"""Pair counts against brute force, the null against its margins, the tail against exact convolution."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum.llm import cooccurrence as co


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, items array<string>, n_ab int")


def some(rng, n=60):
    return [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))] + (["hot"] if i % 3 else []) + ([None] if i % 5 == 0 else []), 0) for i in range(n)]


@pytest.mark.parametrize("least", [1, 5])
def test_counts(spark, least):
    rows = some(random.Random(2))
    want, freq = Counter(), Counter()
    for _, items, _ in rows:
        own = sorted({x for x in items if x})
        freq.update(own)
        want.update(itertools.combinations(own, 2))
    n = sum(1 for _, items, _ in rows if any(items))
    got = co.surprise(co.baskets(frame(spark, rows), "id", F.col("items")), least).collect()
    assert {(r["a"], r["b"]): r["n_ab"] for r in got} == {k: v for k, v in want.items() if v >= least}
    for r in got:
        assert (r["n_a"], r["n_b"], r["n"]) == (freq[r["a"]], freq[r["b"]], n)
        assert abs(r["pmi"] - math.log2(r["n_ab"] * n / (r["n_a"] * r["n_b"]))) < 1e-9
        assert r["log10_p"] <= 0 <= r["q_value"] <= 1


def test_empty_and_lonely(spark):
    assert co.surprise(co.baskets(frame(spark, []), "id", F.col("items"))).count() == 0
    assert co.surprise(co.baskets(frame(spark, [(1, ["a"], 0), (2, [], 0), (3, None, 0), (None, ["a", "b"], 0)]), "id", F.col("items"))).count() == 0


def test_false_discovery_rates(spark):
    scored = pd.DataFrame({"log10_p": [-9.0, -3.0, -3.0, -2.5, -0.1, -0.1], "m": [1, 2, 1, 3, 10, 1]})
    tests = 40
    p = np.repeat(10 ** scored["log10_p"].to_numpy(), scored["m"])
    p.sort()
    raw = np.minimum(1, p * tests / np.arange(1, len(p) + 1))
    # equal p-values share the last rank among them
    want = {round(math.log10(v), 6): min(raw[i] for i in range(len(p)) if p[i] >= v and (i == len(p) - 1 or p[i + 1] > p[i])) for v in p}
    got = {r["log10_p"]: r["q_value"] for r in co.step_up(spark.createDataFrame(scored), tests).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_null_keeps_margins():
    items = pd.DataFrame({"cls": [1, 5, 40], "mean": [1.0, 5.0, 40.0], "count": [30, 10, 3]})
    sizes = pd.DataFrame({"cls": [2, 4], "mean": [2.0, 4.0], "count": [60, 20]})
    x, y = co.fit(items, sizes)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ sizes["count"], items["mean"], rtol=1e-3)
    assert np.allclose(items["count"].to_numpy() @ p, sizes["mean"], rtol=1e-3)


def test_tail_against_convolution():
    rng = np.random.default_rng(0)
    for _ in range(20):
        q, n = rng.uniform(0.001, 0.4, 4), rng.integers(1, 30, 4)
        dist = np.ones(1)
        for a, m in zip(q, n):
            for _ in range(m):
                dist = np.convolve(dist, [1 - a, a])
        for c in range(1, int(n.sum())):
            exact = dist[c:].sum()
            if exact > 1e-250:
                got = co.tail(q[None], n.astype(float), np.array([c]))[0]
                assert abs(got - math.log10(exact)) < 0.08, (c, got, math.log10(exact))


def test_size_class(spark):
    got = spark.createDataFrame([(v,) for v in (1, 63, 64, 65, 10**12)], "n bigint").select(co.size_class(F.col("n")).alias("c")).collect()
    c = [r["c"] for r in got]
    assert c[:3] == [1, 63, 64] and c == sorted(c) and c[-1] < 900


def test_blocks_of_large_baskets(spark, monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 4)
    rows = [(i, [f"w{(i * k) % 23}" for k in range(n)], 0) for i, n in enumerate([1, 2, 4, 5, 9, 17, 22, 3])]
    want = Counter(p for _, items, _ in rows for p in itertools.combinations(sorted(set(items)), 2))
    got = co.pair_counts(co.baskets(frame(spark, rows), "id", F.col("items")))[0].collect()
    assert {(r["a"], r["b"]): r["n_ab"] for r in got} == want and len(got) == len(want)


def test_size_of_baskets_explains(spark):
    """Two rare items that meet six times: where a few baskets hold nearly everything the null explains it, among small
    baskets it doesn't, though PMI is the same."""
    small = [(i, [f"s{i}", f"t{i}"], 0) for i in range(400)]
    giant = [(1000 + i, ["x", "y", *[f"v{k}" for k in range(300)]], 0) for i in range(6)]
    close = [(1000 + i, ["x", "y"], 0) for i in range(6)]
    explained, surprising = ({(r["a"], r["b"]): r for r in co.surprise(co.baskets(frame(spark, small + more), "id", F.col("items")), 5).collect()}["x", "y"] for more in (giant, close))
    assert explained["n_ab"] == surprising["n_ab"] == 6 and explained["pmi"] == surprising["pmi"] > 3
    assert explained["log10_p"] > -3 > surprising["log10_p"]
    assert explained["q_value"] > 0.05 >= surprising["q_value"]


def test_width_of_classes(spark):
    """The expectation of frequent items, which share a class, is that of their own frequencies."""
    rng = random.Random(4)
    rows = [(i, [w for w, k in (("a", 2), ("b", 3), ("c", 5)) if rng.random() < 1 / k / 4], 0) for i in range(4000)] + [(9000 + i, [f"z{i}"], 0) for i in range(3000)]
    for r in co.surprise(co.baskets(frame(spark, rows), "id", F.col("items"))).filter("n_a > 64 and n_b > 64").collect():
        assert abs(r["expected"] / (r["n_a"] * r["n_b"] / r["n"]) - 1) < 0.6
