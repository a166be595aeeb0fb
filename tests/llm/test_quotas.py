"""Totals of the splits: as near as whole components allow, at every size of table."""

import random

import pytest

from vellum.llm import splits

SHARES = [0.8, 0.1, 0.1]


def totals(sizes):
    q = splits.quotas(sizes, SHARES)
    assert {x.size: sum(x.parts) for x in q} == dict(sizes) and all(n >= 0 for x in q for n in x.parts)
    return [sum(x.size * x.parts[k] for x in q) for k in range(3)]


@pytest.mark.parametrize("sizes", [[(5, 1_000_000)], [(4, 2_500_000)], [(3, 1_000_000), (5, 900_000), (8, 70_000)], [(7, 90_000_000), (11, 30_000_000), (333_333_333, 1)]])
def test_no_singles(sizes):
    total = sum(s * c for s, c in sizes)
    assert all(abs(p - total * s) <= min(s for s, _ in sizes) / 2 + 1 for p, s in zip(totals(sizes), SHARES))


def test_a_billion_records():
    rng = random.Random(8)
    sizes = [(s, int(4e8 / s**2.2) + 1) for s in range(1, 400)] + [(rng.randint(1000, 10**6), 1) for _ in range(200)] + [(3 * 10**8, 1)]
    sizes = sorted(dict(sizes).items())
    total = sum(s * c for s, c in sizes)
    assert total > 1e9
    assert all(abs(p - total * s) <= 1 for p, s in zip(totals(sizes), SHARES))


def test_choice_against_all_sums():
    rng = random.Random(6)
    for _ in range(400):
        sizes = [(s, rng.randint(1, 6)) for s in rng.sample(range(1, 60), rng.randint(1, 5))]
        sums = {0}
        for s, c in sizes:
            sums = {x + n * s for x in sums for n in range(c + 1)}
        target = rng.randint(0, max(sums))
        took = splits.choose(sizes, target)
        assert all(0 <= took[s] <= c for s, c in sizes)
        assert abs(sum(s * n for s, n in took.items()) - target) == min(abs(x - target) for x in sums)


def test_only_large_and_none():
    assert totals([(10, 1)]) == [10, 0, 0]
    assert splits.quotas([], SHARES) == []
    assert splits.choose([(10, 3)], 4) == {10: 0}
