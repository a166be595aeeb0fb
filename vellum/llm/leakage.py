"""Evaluation texts leaking into training text: MinHash containment search, verified by exact shingles and alignment.

Items are cut into windows of WINDOW words and documents into overlapping blocks of at most BLOCK shingles of five words, so
that a short passage is a large part of some block however long its document is. Blocks are partitioned by size; a size
fixes which Jaccard similarity the least containment means, and with it how many hash functions are probed, each a band of
one row, for a miss probability under MISS. A block that shares a minimum with a window of an item is a candidate; it is
verified in the same task on the document's own words, so no text and no signature is ever shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import tokens

SHINGLE, WINDOW, HALF = 5, 18, 16
BLOCK = 2 * HALF
#: Of a window's 14 shingles, the fewest that a passage with one word in ten altered keeps (20 words, alterations a third
#: and two thirds through).
LEAST = 4
MISS = 2e-3
#: Items are sought in blocks of so many words, each in one pass over the documents: what is sent to the tasks is bounded.
#: An index of so many words was measured at 100 MB and 2 s to build, once a Python worker.
ITEM_WORDS = 500_000
#: Items whose shingles a worker holds for verification.
KEPT = 2000


def functions_for(size: int) -> int:
    """How many hash functions find, all but MISS of the time, LEAST common shingles of a window and a block of `size`."""
    jaccard = LEAST / (WINDOW - SHINGLE + 1 + max(size, LEAST) - LEAST)
    return math.ceil(math.log(MISS) / math.log1p(-jaccard))


#: Upper ends of the size partitions of blocks, and the hash functions probed in each.
PARTITIONS = [(size, functions_for(size)) for size in (8, 16, BLOCK)]
K = PARTITIONS[-1][1]
_seed = np.random.default_rng(20240229)
MULTIPLY, ADD = _seed.integers(0, 1 << 32, K, np.uint32) | np.uint32(1), _seed.integers(0, 1 << 32, K, np.uint32)


def hash_k(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = h * MULTIPLY[k] + ADD[k]
        return v ^ (v >> np.uint32(15))


def least_in(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` successive values, by doubling."""
    span = 1
    while span * 2 <= width:
        v, span = np.minimum(v[:-span], v[span:]), span * 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


class Index:
    """Items of one block: their windows' minima by hash function, and all their words.

    Built in one pass over the joined items, in flat arrays: some 200 bytes a word of the items. What verification needs of
    an item (its shingles by hash) is made when the item first becomes a candidate, for KEPT items at a time.
    """

    def __init__(self, items: list[tuple]):
        self.keys, self.words, self.least = [], [], []
        self._shingles: dict[int, dict] = {}
        for key, text in items:
            found = tokens.words(text or "")
            if len(found) < SHINGLE:
                continue
            single = sum(len(w) == 1 and tokens.CJK_CHAR.match(w) is not None for w in found)
            self.keys.append(key)
            self.words.append(tokens.hashed(found))
            self.least.append(60 if single * 2 > len(found) else WINDOW)
        self.tables = []
        if not self.keys:
            return
        n = np.array([len(w) for w in self.words], np.int64)
        low = (tokens.rolling(np.concatenate(self.words), SHINGLE)[tokens.inside(n, SHINGLE)] >> np.uint64(32)).astype(np.uint32)
        own, wide = n - SHINGLE + 1, WINDOW - SHINGLE + 1
        starts = np.cumsum(own) - own
        sliding, short = tokens.inside(own, wide), np.flatnonzero(own < wide)
        owner = np.concatenate([np.repeat(np.arange(len(n)), np.maximum(own - wide + 1, 0)), short]).astype(np.uint64)
        edges = np.stack([starts[short], starts[short] + own[short]], 1).ravel()
        for k in range(K):
            h = hash_k(low, k)
            part = [least_in(h, wide)[sliding]] if len(sliding) else []
            if len(short):
                part.append(np.minimum.reduceat(np.append(h, np.uint32(0xFFFFFFFF)), edges)[::2])
            v = (np.concatenate(part).astype(np.uint64) << np.uint64(32)) | owner
            pairs = np.unique(v[np.concatenate([[True], v[1:] != v[:-1]])])
            values, first = np.unique((pairs >> np.uint64(32)).astype(np.uint32), return_index=True)
            bits = max(16, min(28, int(len(values) * 8).bit_length()))
            maybe = np.zeros(1 << bits, bool)
            maybe[values >> np.uint32(32 - bits)] = True
            self.tables.append((maybe, np.uint32(32 - bits), values, np.append(first, len(pairs)).astype(np.uint32), pairs.astype(np.uint32)))

    def size(self) -> int:
        """Bytes of the tables."""
        return sum(t.nbytes for row in self.tables for t in row if isinstance(t, np.ndarray)) + sum(w.nbytes for w in self.words)

    def shingles(self, item: int) -> dict[int, list[int]]:
        """Positions of the item's shingles by hash."""
        if item not in self._shingles:
            if len(self._shingles) >= KEPT:
                self._shingles.clear()
            at = defaultdict(list)
            for i, v in enumerate(tokens.rolling(self.words[item], SHINGLE).tolist()):
                at[v].append(i)
            self._shingles[item] = dict(at)
        return self._shingles[item]

    def candidates(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(block, item) that share a minimum; starts are those of half blocks in `low`, a block is a half and the next one
        of its text, as `sizes` (shingles of the block) tells."""
        out: set[tuple[int, int]] = set()
        if not len(starts) or not self.tables:
            return out
        joined = sizes > np.diff(np.append(starts, len(low)))
        nxt = np.minimum(np.arange(len(starts)) + 1, len(starts) - 1)
        probes = np.full(len(starts), K)
        for end, need in reversed(PARTITIONS):
            probes[sizes <= end] = need
        for k in range(K):
            half = np.minimum.reduceat(hash_k(low, k), starts)
            block = np.where(joined, np.minimum(half, half[nxt]), half)
            maybe, shift, values, first, owner = self.tables[k]
            hit = np.flatnonzero(maybe[block >> shift] & (probes > k))
            if len(hit):
                v = block[hit]
                pos = np.minimum(np.searchsorted(values, v), len(values) - 1)
                for b, p in zip(hit[values[pos] == v].tolist(), pos[values[pos] == v].tolist()):
                    out.update((b, i) for i in owner[first[p] : first[p + 1]].tolist())
        return out

    def holds(self, item: int, doc: np.ndarray, lo: int, hi: int) -> bool:
        """Whether the words of a document hold a passage of the item that touches the shingles from lo to hi: as many
        distinct shingles in common around them as the least passage keeps, and an alignment of enough of the item's words, one in ten altered."""
        at, least = self.shingles(item), self.least[item]
        margin = least + least // 10
        lo, hi = max(0, lo - margin), min(len(doc) - SHINGLE + 1, hi + margin)
        s = tokens.rolling(doc[lo : hi + SHINGLE - 1], SHINGLE).tolist()
        seeds = [(lo + i, j) for i, v in enumerate(s) if v in at for j in at[v]]
        if len({j for _, j in seeds}) < fewest(least):
            return False
        word, covered = self.words[item].tolist(), set()
        near = doc[max(0, lo - 2 * len(word)) : hi + 2 * len(word)].tolist()
        shift = max(0, lo - 2 * len(word))
        for i, j in seeds:
            if (i - j, j) in covered:
                continue
            a, b = i - shift, j
            while a > 0 and b > 0 and near[a - 1] == word[b - 1]:
                a, b = a - 1, b - 1
            e = b
            d = a
            while d < len(near) and e < len(word) and near[d] == word[e]:
                covered.add((i - j, e))
                d, e = d + 1, e + 1
            if passes(near, word, (a, b), (d, e), least):
                return True
        return False


def fewest(least: int) -> int:
    """The fewest shingles that a passage of `least` or more words keeps when one in ten is altered, alterations spread
    evenly: each run between two of them has its words less four."""
    return min(n - n // 10 - (SHINGLE - 1) * (n // 10 + 1) for n in range(least, 2 * least + 12))


def reach(near: list[int], word: list[int], a: int, b: int, step: int, most: int, debt: int) -> list[int]:
    """How many of the item's words lie between b and the last one matched with 0, 1, ... most alterations, going by `step`
    from (a, b): furthest reaching points on each diagonal. It ends where words fall short of ten an alteration by more than
    `debt`."""
    n, m = len(near), len(word)
    out, front = [0], {0: (0, 0)}  # diagonal (item less document): words of the item taken, words matched up to
    best = 0
    for _ in range(most):
        new: dict[int, tuple[int, int]] = {}
        for diag, (x, last) in front.items():
            for d2, x2 in ((diag, x + 1), (diag - 1, x), (diag + 1, x + 1)):  # changed, added, dropped
                y2 = x2 - d2
                if x2 > (m - b if step > 0 else b) or y2 > (n - a if step > 0 else a) or y2 < 0:
                    continue
                xx, ll = x2, last
                while True:
                    p, q = (b + xx, a + xx - d2) if step > 0 else (b - 1 - xx, a - 1 - xx + d2)
                    if not (0 <= p < m and 0 <= q < n) or near[q] != word[p]:
                        break
                    xx += 1
                    ll = xx
                if d2 not in new or new[d2] < (xx, ll):
                    new[d2] = (xx, ll)
        front = new
        best = max([best, *(ll for _, ll in front.values())])
        out.append(best)
        if not front or best + debt < 10 * (len(out) - 1):
            break
    return out


def passes(near: list[int], word: list[int], start: tuple[int, int], end: tuple[int, int], least: int) -> bool:
    """Whether the run from start to end extends to a passage of `least` or more words of the item with at most one in ten
    altered, that begins and ends with a match."""
    run = end[1] - start[1]
    if run >= least:
        return True
    most = len(word) // 10
    # Seen from the longest run of a passage, no alteration on the other side can win more than run - 9 words over its ten.
    debt = run + max(0, run - 9) * most
    right, left = reach(near, word, *end, 1, most, debt), reach(near, word, *start, -1, most, debt)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            n = x + run + y
            if n >= least and 10 * (i + j) <= n:
                return True
    return False


#: The index of the block that a Python worker works on; its next task finds it built.
_BUILT: dict[str, Index] = {}


def built(name: str, items: list[tuple]) -> Index:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(items)
    return _BUILT[name]


def search(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_key, item_key): every document with each item of which it holds a passage of at least 18 successive words (60
    characters if the item is mostly Chinese or Japanese), one word in ten altered.

    Items are the stated query set: they come to the driver in blocks of at most `item_words` words (by a running total of
    their sizes), each block is sent to the tasks and sought in one pass over all documents; more items mean more passes,
    never a larger broadcast. A Python worker builds a block's index once, for all its tasks. Null or short items and texts match nothing, equal keys give equal rows once a row.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    src = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).filter("text is not null")
    schema = f"{doc_key} {kinds[0]}, {item_key} {kinds[1]}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def sought(block: list[tuple]) -> DataFrame:
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def seek(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = built(name, sent.value)
            for rows in tokens.groups(tokens.batches(it)):
                found = in_texts(index, [t for _, t in rows])
                yield pa.RecordBatch.from_pydict({doc_key: [rows[d][0] for d, _ in found], item_key: [index.keys[i] for _, i in found]}, arrow)

        return src.mapInArrow(seek, schema)

    out, block, held = None, [], 0
    for r in items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).filter("t is not null").toLocalIterator():
        block.append((r["k"], r["t"]))
        held += len(r["t"]) // 2
        if held >= item_words:
            part, block, held = sought(block), [], 0
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = sought(block)
        out = part if out is None else out.unionByName(part)
    return out


def in_texts(index: Index, texts: list[str]) -> list[tuple[int, int]]:
    """(text, item) of the texts that hold a passage of an item."""
    hashes = [tokens.hashed(tokens.words(t)) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    own = np.maximum(n - SHINGLE + 1, 0)
    if not own.sum():
        return []
    s = tokens.rolling(np.concatenate(hashes), SHINGLE)[tokens.inside(n, SHINGLE)]
    low = (s >> np.uint64(32)).astype(np.uint32)
    halves = -(-own // HALF)
    first = np.cumsum(own) - own
    text = np.repeat(np.arange(len(texts)), halves)
    rank = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves)
    starts = first[text] + rank * HALF
    sizes = np.minimum(own[text] - rank * HALF, BLOCK)
    out, seen = [], set()
    for b, i in sorted(index.candidates(low, starts, sizes)):
        d = int(text[b])
        if (d, i) not in seen and index.holds(i, hashes[d], int(rank[b]) * HALF, int(rank[b]) * HALF + int(sizes[b])):
            seen.add((d, i))
            out.append((d, i))
    return out
