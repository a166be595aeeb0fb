"""Filling containers of fixed capacity with items: histogram packing by non-negative least squares.

The plan is made from the histogram of sizes alone (at most `capacity` rows, whatever the number of items): few-item length
patterns that fill a container are fitted to the histogram, rounded to whole repeat counts and filled with real lengths, and
what is left over is packed by best fit into the gaps and into new containers, whole groups of equal containers at a time.
Items then find their container by their rank among items of their size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import group_rank
from ..session import cut

#: Lengths are taken in this many classes when patterns are enumerated.
CLASSES = 256
#: A container made by a pattern leaves at most so many tokens unused.
WASTE = 2


def byte_tokens(text: Column) -> Column:
    """Size in tokens of the public ByT5 tokenizer: one a UTF-8 byte, plus the end token. A null text has no size."""
    return (F.octet_length(text) + 1).cast("bigint")


def patterns(classes: int, most: int = 3) -> np.ndarray:
    """The ways to write `classes` as a sum of at most `most` (up to 3) classes, largest first; 0 is no item."""
    out = []
    for a in range(classes, 0, -1):
        if a == classes:
            out.append((a, 0, 0))
        elif most > 1:
            rest = classes - a
            if rest <= a:
                out.append((a, rest, 0))
            if most > 2:
                out += [(a, b, rest - b) for b in range(min(a, rest - 1), (rest + 1) // 2 - 1, -1)]
    return np.array(out, int)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: active sets after Lawson and Hanson. Each step lowers the residual, so no active set
    comes twice and it ends at the optimum; it also ends where a step lowers the residual by rounding errors only."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale, last = 1e-9 * (np.abs(b).max(initial=0) + 1), np.inf
    while True:
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(w.argmax())
        if not w[j] > scale:
            return x
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if (s > 0).all():
                break
            bad = s <= 0
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - s[bad], 1e-300))
            x[idx] += step * (s - x[idx])
            drop = idx[bad & (x[idx] <= scale)]
            if not len(drop):
                drop = idx[bad][:1]
            free[drop], x[drop] = False, 0.0
        x[:] = 0.0
        x[idx] = s
        now = float(np.linalg.norm(b - a @ x))
        if not now < last * (1 - 1e-12):
            return x
        last = now


@dataclass
class Plan:
    """Items take positions in the order of size, equal sizes by rank. Positions from start[i] up go to containers from
    base[i] up, each taking each[i] of them."""

    sizes: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    base: np.ndarray
    each: np.ndarray
    containers: int
    used: int



def heads(groups: list[list[int]], chosen: tuple[int, ...] = ()) -> Iterator[tuple[int, ...]]:
    """Every way to take one size of each group (largest first), equal groups in falling order."""
    if not groups:
        yield chosen
        return
    for k in groups[0]:
        if not chosen or k <= chosen[-1]:
            yield from heads(groups[1:], (*chosen, k))


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES, waste: int = WASTE) -> Plan:
    """The packing of histogram[size] items of each size from 1 to capacity. Its length is bounded by the numbers of sizes,
    classes and patterns, not by the number of items.

    Patterns are fitted to the histogram of classes. A pattern's containers are then filled with real lengths: all items but
    the smallest from their classes, the last one the longest that still fits. Containers that would leave more than `waste`
    tokens unused aren't made; their items are packed with what the rounding left over.
    """
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    step = -(-capacity // classes)
    classes = capacity // step
    cls = np.minimum(-(-sizes // step), classes + 1)  # sizes beyond the last whole class are packed as leftovers
    have = np.bincount(cls, counts, classes + 2).astype(np.int64)[: classes + 1]
    of_class = {int(c): np.flatnonzero(cls == c)[::-1].tolist() for c in np.unique(cls)}
    taken = np.zeros(len(sizes), np.int64)
    pats = patterns(classes)
    pats = pats[((have[pats] > 0) | (pats == 0)).all(1)]
    segments, n = [], 0  # segments (start, base, each, items)
    open_by: dict[int, list[tuple[int, int]]] = {}  # free tokens: (base, containers)
    if len(pats):
        a = np.zeros((classes + 1, len(pats)))
        for k in range(3):
            np.add.at(a, (pats[:, k], np.arange(len(pats))), (pats[:, k] > 0).astype(float))
        fitted = np.rint(nnls(a[1:], have[1:].astype(float))).astype(np.int64)
        for p in np.argsort(-fitted, kind="stable"):
            left = int(fitted[p])
            if left <= 0:
                break
            for chosen in heads([of_class[int(c)] for c in pats[p] if c][:-1]):
                rest = capacity - int(sizes[list(chosen)].sum())
                last = int(np.searchsorted(sizes, rest, "right")) - 1
                while left > 0 and last >= 0 and rest - sizes[last] <= waste:
                    use = Counter((*chosen, last))
                    m = min(left, *(int(counts[k] - taken[k]) // u for k, u in use.items()))
                    if m <= 0:
                        if all(counts[k] - taken[k] >= u for k, u in Counter(chosen).items()):
                            last -= 1  # this length is used up, try the next shorter one
                            continue
                        break
                    for k, u in use.items():
                        for _ in range(u):
                            segments.append((int(offsets[k] + taken[k]), n, 1, m))
                            taken[k] += m
                    if rest > sizes[last]:
                        open_by.setdefault(int(rest - sizes[last]), []).append((n, m))
                    left, n = left - m, n + m
                if left <= 0:
                    break
    # leftovers, largest first, each into the fullest container that takes it
    for i in range(len(sizes) - 1, -1, -1):
        size, lo = int(sizes[i]), int(offsets[i] + taken[i])
        left = int(offsets[i + 1]) - lo
        for free in sorted(f for f in open_by if f >= size):
            per = free // size
            while left and open_by.get(free):
                base, count = open_by[free].pop()
                k = min(count, left // per) if left >= per else 1
                m = min(per, left)
                segments.append((lo, base, m, k * m))
                lo, left = lo + k * m, left - k * m
                if free - m * size:
                    open_by.setdefault(free - m * size, []).append((base, k))
                if count > k:
                    open_by[free].append((base + k, count - k))
            if not left:
                break
        while left > 0:
            per = capacity // size
            k, m = (left // per, per) if left >= per else (1, left)
            segments.append((lo, n, m, k * m))
            if capacity - m * size:
                open_by.setdefault(capacity - m * size, []).append((n, k))
            lo, left, n = lo + k * m, left - k * m, n + k
    segments.sort()
    col = lambda k: np.array([s[k] for s in segments], np.int64)
    return Plan(sizes, offsets, col(0), col(1), col(2), n, int((sizes * counts).sum()))


def pack(items: DataFrame, key: str, size: Column, capacity: int) -> DataFrame:
    """(key, piece, offset, tokens, container): every item of a positive size in containers of `capacity`.

    An item is split only if it exceeds the capacity: into full containers of its own and a last piece, which is packed like
    any item. Items of null or no size are left out. Equal (key, size) rows are different items. Containers are numbered
    from 0, those of full pieces after the packed ones. Sizes are read once and kept in a written table; only the histogram
    comes to the driver. Ranks within a size are spread over buckets, so one size may hold any share of the items.
    """
    sized = cut(items.select(F.col(key).alias("key"), size.cast("bigint").alias("size")).filter("size > 0").withColumn("row", F.monotonically_increasing_id()))
    full = F.floor((F.col("size") - 1) / capacity).cast("bigint")
    sized = sized.withColumn("full", full).withColumn("rest", F.col("size") - F.col("full") * capacity)
    counted = sized.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()  # at most `capacity` rows
    histogram, pieces = {r["rest"]: r["n"] for r in counted}, sum(r["full"] for r in counted)
    if not histogram:
        return sized.select(F.col("key").alias(key), F.lit(0).cast("int").alias("piece"), F.lit(0).cast("bigint").alias("offset"), F.col("size").alias("tokens"), F.lit(0).cast("bigint").alias("container"))
    p = plan(histogram, capacity)
    rows = sum(histogram.values())
    ranked = group_rank(sized, "rest", ["row"], rows=rows)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pos = p.offsets[np.searchsorted(p.sizes, pdf["rest"].to_numpy())] + pdf["rank"].to_numpy()
            s = np.searchsorted(p.start, pos, "right") - 1
            pdf["container"] = p.base[s] + (pos - p.start[s]) // p.each[s]
            yield pdf[["key", "row", "size", "full", "rest", "container"]]

    kind = dict(sized.dtypes)["key"]
    placed = ranked.select("key", "row", "size", "full", "rest", "rank").mapInPandas(place, f"key {kind}, row bigint, size bigint, full bigint, rest bigint, container bigint")
    one = placed.select("key", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("offset"), F.col("rest").alias("tokens"), "container")
    # the full pieces of oversize items: numbered by rank, spread over buckets like the rest
    over = sized.filter("full > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), F.concat_ws(":", "row", "piece").alias("at"))
    over = group_rank(over.withColumn("all", F.lit(1)), "all", ["at"], rows=pieces)
    split = over.select("key", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).cast("bigint").alias("offset"), F.lit(capacity).cast("bigint").alias("tokens"), (F.col("rank") + p.containers).cast("bigint").alias("container"))
    return one.unionByName(split).withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens and their share of the capacity, items split, and containers overfull (0)."""
    by = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"))
    return by.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * F.lit(capacity))).alias("fill"), F.sum((F.col("t") > capacity).cast("bigint")).alias("overfull"), F.max("pieces").alias("most_pieces"))
