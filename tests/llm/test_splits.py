"""Groups against union-find, splits against exhaustive choice."""

import itertools
import random
from collections import Counter, defaultdict

from vellum.llm import splits


def union(records, ties):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in records:
        root("r:" + r)
    for u, v in ties:
        if u and v:
            up[root(u)] = root(v)
    out = defaultdict(list)
    for r in records:
        out[root("r:" + r)].append(r)
    return {(min(g), r) for g in out.values() for r in g}


def test_groups(spark):
    rng = random.Random(4)
    records = [f"k{i:03}" for i in range(120)]
    ties = [("r:" + r, f"a:{rng.randint(0, 80)}") for r in records] + [(f"a:{rng.randint(0, 80)}", f"w:{rng.randint(0, 60)}") for _ in range(60)] + [("r:" + r, "a:hot") for r in records[::3]] + [("r:k001", None), (None, "a:1")]
    chain = [(f"r:k{i:03}", f"s:{i}") for i in range(100, 119)] + [(f"r:k{i + 1:03}", f"s:{i}") for i in range(100, 119)]
    r = spark.createDataFrame([(x, 1) for x in records + records[:5]], "id string, root int").select("id")
    t = spark.createDataFrame(ties + chain, "u string, v string")
    got = {tuple(x) for x in splits.groups(r, [t]).collect()}
    assert got == union(records, ties + chain)


def test_no_ties(spark):
    r = spark.createDataFrame([("b",), ("a",), (None,)], "id string")
    t = spark.createDataFrame([], "u string, v string")
    assert {tuple(x) for x in splits.groups(r, [t]).collect()} == {("a", "a"), ("b", "b")}


def test_choice_is_the_nearest():
    rng = random.Random(8)
    for _ in range(60):
        sizes = [(s, rng.randint(1, 3)) for s in rng.sample(range(1, 15), rng.randint(1, 4))]
        sums = {sum(s * n for (s, _), n in zip(sizes, ns)) for ns in itertools.product(*[range(c + 1) for _, c in sizes])}
        target = rng.randint(0, sum(s * c for s, c in sizes))
        got = splits.choose(sizes, target)
        assert all(0 <= got[s] <= c for s, c in sizes)
        assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(v - target) for v in sums)


def test_large_totals():
    sizes = [(1, 5_000_000), (7, 300_000), (1_000_000, 3), (250_001, 5)]
    q = splits.quotas(sizes, [0.8, 0.1, 0.1])
    total = sum(s * c for s, c in sizes)
    parts = [sum(x.size * x.parts[k] for x in q) for k in range(3)]
    assert sum(parts) == total and all(sum(x.parts) == dict(sizes)[x.size] for x in q)
    assert all(abs(p / total - s) < 0.001 for p, s in zip(parts, [0.8, 0.1, 0.1]))


def test_assign(spark):
    rng = random.Random(1)
    rows = [(f"g{i}", f"g{i}r{j}") for i in range(150) for j in range(1 if i % 3 else rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "group string, record string")
    got = splits.assign(df, ["train", "validation", "test"], [0.8, 0.1, 0.1]).collect()
    by = defaultdict(set)
    for r in got:
        by[r["group"]].add(r["split"])
    n = Counter(r["split"] for r in got)
    assert len(got) == len(rows) and all(len(v) == 1 for v in by.values())
    assert abs(n["test"] - 0.1 * len(rows)) <= 1 and abs(n["validation"] - 0.1 * len(rows)) <= 1
    assert splits.assign(df.limit(0), ["a", "b"], [0.5, 0.5]).count() == 0
