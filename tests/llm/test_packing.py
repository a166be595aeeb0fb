"""Containers: nothing lost, nothing overfull, and little space unused."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import packing


def loads(p):
    pos = np.arange(p.offsets[-1])
    s = np.searchsorted(p.start, pos, "right") - 1
    box = p.base[s] + (pos - p.start[s]) // p.each[s]
    return np.bincount(box, p.sizes[np.searchsorted(p.offsets, pos, "right") - 1], p.containers)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.dictionaries(st.integers(1, 400), st.integers(1, 300), min_size=1, max_size=40))
def test_plans(capacity, histogram):
    h = {min(s, capacity): n for s, n in histogram.items()}
    load = loads(packing.plan(h, capacity))
    assert load.max() <= capacity and load.min() > 0
    assert load.sum() == sum(s * n for s, n in h.items())


def test_little_unused():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(7.2, 1.0, 20_000).astype(int) + 1, 8192)
    p = packing.plan(dict(zip(*(v.tolist() for v in np.unique(sizes, return_counts=True)))), 8192)
    assert p.used / (p.containers * 8192) > 0.985
    # the plan's length follows the numbers of sizes and patterns, not of items
    q = packing.plan({int(s): int(n) * 1000 for s, n in zip(*np.unique(sizes, return_counts=True))}, 8192)
    assert len(q.start) < 5 * len(p.start)


def test_fit_is_the_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 6)), np.array([0.0, 2.0, 0.0, 1.0, 3.0, 0.0])
    got = packing.nnls(a, a @ x)
    assert np.allclose(got, x, atol=1e-6)
    b = rng.normal(size=12)
    y = packing.nnls(a, b)
    w = a.T @ (b - a @ y)
    assert (y >= 0).all() and (w <= 1e-6).all() and np.allclose(w[y > 1e-9], 0, atol=1e-6)


def test_frame(spark):
    texts = ["x" * 100] * 40 + ["é" * 30, "", "z" * 256, "w" * 1000, None, "y"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, "again", "c")], "id int, text string, container string")
    got = packing.pack(df, "id", packing.byte_tokens(F.col("text")), 256).collect()
    want = {i: len(t.encode()) + 1 for i, t in enumerate(texts) if t is not None}
    by, box = {}, {}
    for r in got:
        by[r["id"]] = by.get(r["id"], 0) + r["tokens"]
        box[r["container"]] = box.get(r["container"], 0) + r["tokens"]
        assert r["offset"] == r["piece"] * 256
    want[0] += len("again") + 1
    assert by == want and max(box.values()) <= 256
    assert {r["id"] for r in got if r["piece"] > 0} == {42, 43}
    assert sorted(box) == list(range(len(box)))
    assert packing.pack(df.limit(0), "id", packing.byte_tokens(F.col("text")), 256).count() == 0


def test_one_size_for_all(spark):
    df = spark.range(3000).select(F.col("id"), F.lit(100).alias("s"))
    f = packing.fill(packing.pack(df, "id", F.col("s"), 1000), 1000).first()
    assert f["containers"] == 300 and f["fill"] == 1.0 and f["overfull"] == 0


def best_fit(sizes, capacity):
    """Containers that best fit in falling order needs, item by item."""
    free = []
    for s in sorted(sizes, reverse=True):
        k = min((k for k, f in enumerate(free) if f >= s), key=lambda k: free[k], default=None)
        if k is None:
            free.append(capacity - s)
        else:
            free[k] -= s
    return len(free)


def test_patterns_pay(monkeypatch):
    """With the fitted patterns no more containers than best fit alone, and fewer on sizes where best fit goes wrong."""
    rng = np.random.default_rng(2)
    for _ in range(5):
        sizes = np.minimum(rng.lognormal(6.2, 0.8, 2500).astype(int) + 1, 2048).tolist()
        h = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
        assert packing.plan(h, 2048).containers <= best_fit(sizes, 2048)
    hard = {520: 60, 510: 60, 500: 60, 270: 120, 254: 240}
    with_patterns = packing.plan(hard, 1024).containers
    monkeypatch.setattr(packing, "nnls", lambda a, b: np.zeros(a.shape[1]))
    assert with_patterns <= packing.plan(hard, 1024).containers
    assert with_patterns <= best_fit([s for s, n in hard.items() for _ in range(n)], 1024)
