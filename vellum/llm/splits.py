"""Train, validation and test splits that keep related records together.

Records and what ties them (articles, authors, sources) are the two kinds of node of a bipartite graph, so a value shared by
any number of records is a star, never a clique. Components come from parallel hooking and shortcutting over a parent table;
components then fill the splits so that the totals come as close to the asked shares as whole components allow.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import group_rank
from ..session import cut


def numbered(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v: string) as a written table (u, v: bigint, us, vs) by a 64-bit hash that is proven free of
    collisions on these nodes; another salt is tried for as long as two nodes collide (with 1e9 nodes once in 40 times).
    Numbers in random order keep the trees of the hooking shallow."""
    for salt in itertools.count():
        h = lambda c: F.xxhash64(F.lit(salt), F.col(c))  # noqa: E731, B023
        out = cut(edges.distinct().select(h("u").alias("u"), h("v").alias("v"), F.col("u").alias("us"), F.col("v").alias("vs")))
        nodes = out.select("u", "us").unionByName(out.select(F.col("v").alias("u"), F.col("vs").alias("us")))
        if nodes.groupBy("u").agg((F.min("us") != F.max("us")).alias("bad")).filter("bad").isEmpty():
            return out


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, parent) after one round: every node hooks onto its least neighbour if that is less than itself, and pointers
    are doubled twice, which flattens trees of up to four levels. Hooking goes downwards only, so there are no cycles."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    p = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("parent")))
    return cut(doubled(doubled(p)))


def doubled(p: DataFrame) -> DataFrame:
    up = p.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return p.join(up, "parent").select("node", F.col("grand").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of edges (u, v: bigint); root names the component.

    Each round hooks, shortcuts, renames the edges to what their ends now point at and drops those inside a tree and
    repetitions; pointers that aren't flat yet stay as edges of the next round. So the edge table shrinks by a factor each
    round, and it is empty when every node points at its root. Joins are on the ends of edges; a node with a third of all
    edges is split by the engine's skew join, and its least neighbour is found by partial aggregation. No component is held
    in one task. An empty edge table gives no rows.
    """
    e = cut(edges.select("u", "v").filter("u is not null and v is not null").distinct())
    label = e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    rounds = 0
    while not e.isEmpty():
        p = ancestors(e)
        label = label.join(p.select(F.col("node").alias("root"), F.col("parent").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        rounds += 1
        if rounds % 4 == 0:
            label = cut(label)
        a, b = (p.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in "uv")
        inner = e.join(a, "u").join(b, "v").select("pu", "pv")
        steep = p.select(F.col("parent").alias("pu")).join(p.select(F.col("node").alias("pu"), F.col("parent").alias("pv")), "pu").select("pu", "pv")
        e = cut(inner.unionByName(steep).filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    return label


def groups(records: DataFrame, ties: list[DataFrame]) -> DataFrame:
    """(group, record): every record with the least record tied to it, directly or through others.

    records holds one column, ties are tables (u, v) of strings: a record or a tying value on either side; the kinds must be
    told apart by a prefix, as record nodes are by "r:". Records without ties form groups of their own.
    """
    name = records.columns[0]
    own = records.select(F.col(name).alias("record")).filter("record is not null").distinct()
    edges = None
    for t in ties:
        t = t.select("u", "v").filter("u is not null and v is not null")
        edges = t if edges is None else edges.unionByName(t)
    edges = numbered(edges)
    label = components(edges)
    ids = edges.select("u", "us").unionByName(edges.select(F.col("v").alias("u"), F.col("vs").alias("us"))).filter("us like 'r:%'").distinct()
    root = ids.join(label, ids["u"] == label["node"]).select(F.expr("substring(us, 3)").alias("record"), "root")
    tied = own.join(root, "record", "left")
    least = tied.filter("root is not null").groupBy("root").agg(F.min("record").alias("group"))
    return tied.join(least, "root", "left").select(F.coalesce("group", "record").alias("group"), "record")


@dataclass
class Quota:
    """Of `count` components with `size` records each, how many go to each split."""

    size: int
    parts: list[int]


class Sums:
    """A set of sums from 0 to `most`, as sorted, disjoint, closed intervals (lo, hi): a bitset by runs of set bits. With small
    components in number nearly all sums can be reached and the set is a few runs, however many records there are; with few
    components it is few sums. So the sums are exact at every size of table."""

    def __init__(self, most: int, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.most = most
        self.lo = np.zeros(1, np.int64) if lo is None else lo
        self.hi = np.zeros(1, np.int64) if hi is None else hi

    def _joined(self, lo: np.ndarray, hi: np.ndarray) -> Sums:
        keep = lo <= self.most
        lo, hi = lo[keep], np.minimum(hi[keep], self.most)
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        first = np.concatenate([[True], lo[1:] > hi[:-1] + 1])
        last = np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)
        return Sums(self.most, lo[first], hi[last])

    def plus(self, size: int, count: int) -> Sums:
        """The sums with 0 to `count` components of `size` added, in binary chunks. A run at least as wide as `size` takes all
        of them at once."""
        out, chunk = self, 1
        count = min(count, self.most // size) if size else 0
        while count > 0:
            if (out.hi - out.lo + 1 >= size).all():
                return self._joined(out.lo, out.hi + size * count)
            take = min(chunk, count)
            out = self._joined(np.concatenate([out.lo, out.lo + size * take]), np.concatenate([out.hi, out.hi + size * take]))
            count, chunk = count - take, chunk * 2
        return out

    def nearest(self, target: int) -> int:
        """The sum nearest to target (the lower of two)."""
        k = int(np.searchsorted(self.lo, target, "right")) - 1
        below = min(int(self.hi[k]), target)
        if below == target or k + 1 == len(self.lo):
            return below
        above = int(self.lo[k + 1])
        return above if above - target < target - below else below

    def taken(self, value: int, size: int, count: int, wish: int) -> int:
        """How many components of `size`, at most `count` and as near to `wish` as can be, lead from a sum of this set to value."""
        low, high = np.maximum(-((self.hi - value) // size), 0), np.minimum((value - self.lo) // size, count)
        ok = low <= high
        n = np.clip(wish, low[ok], high[ok])
        return int(n[np.abs(n - wish).argmin()])


def choose(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many components of each (size, count) sum as near to target as any choice can: reachable sums forwards from the
    smallest size, choice backwards; of the choices, one near each size's even share."""
    total = sum(s * c for s, c in sizes)
    unit = math.gcd(*(s for s, c in sizes if c)) if total else 1
    # no sum between the target and its mirror image can be farther off than 0 is
    most = min(total, 2 * target + 1) // unit
    ordered = sorted((s // unit, c) for s, c in sizes if c)
    steps = [Sums(most)]
    for s, c in ordered:
        steps.append(steps[-1].plus(s, c))
    left, out = _unit_nearest(steps[-1], target, unit), {s: 0 for s, _ in sizes}
    for k in range(len(ordered) - 1, -1, -1):
        s, c = ordered[k]
        n = steps[k].taken(left, s, c, round(c * target / max(total, 1)))
        out[s * unit], left = n, left - n * s
    return out


def _unit_nearest(sums: Sums, target: int, unit: int) -> int:
    """The sum, in units, that is nearest to a target in records."""
    a, b = sums.nearest(target // unit), sums.nearest(-(-target // unit))
    return min((a, b), key=lambda x: (abs(x * unit - target), x))


def quotas(sizes: list[tuple[int, int]], shares: list[float]) -> list[Quota]:
    """Splits components (size, count) by shares, the smallest splits first, the last (largest) getting what remains. Each
    total is as near to its share as whole components allow, given the splits before it."""
    total = sum(s * c for s, c in sizes)
    left = dict(sizes)
    parts = {s: [0] * len(shares) for s in left}
    order = sorted(range(len(shares)), key=lambda k: (shares[k], k))
    for k in order[:-1]:
        for s, n in choose(sorted(left.items()), round(total * shares[k] / sum(shares))).items():
            parts[s][k] += n
            left[s] -= n
    for s, c in left.items():
        parts[s][order[-1]] += c
    return [Quota(s, p) for s, p in sorted(parts.items())]


def assign(grouped: DataFrame, names: list[str], shares: list[float]) -> DataFrame:
    """(group, record, split): all records of a group get one split, totals nearest to the shares.

    The driver sees how many components there are of each size: at most sqrt(2 records) rows. Components of one size are
    ranked in the order of a hash without any task holding them all, and take the splits by rank.
    """
    size = cut(grouped.groupBy("group").agg(F.count("*").alias("size")))
    counts = [(r["size"], r["n"]) for r in size.groupBy("size").agg(F.count("*").alias("n")).collect()]
    plan = quotas(counts, shares)
    spark = grouped.sparkSession
    rows = [(q.size, names[k], sum(q.parts[:k]), sum(q.parts[: k + 1])) for q in plan for k in range(len(names)) if q.parts[k]]
    cuts = spark.createDataFrame(rows, "size bigint, split string, lo bigint, hi bigint")
    placed = group_rank(size, "size", ["group"], rows=sum(n for _, n in counts)).join(cuts, "size").filter("rank >= lo and rank < hi").select("group", "split")
    return grouped.join(placed, "group").select("group", "record", "split")
