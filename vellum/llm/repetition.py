"""Repetition inside a single document: the share of words in runs that the document held before, and cutoffs on that share
whose false rejections are bounded for each stratum."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut
from . import tokens

RUN, CHARACTERS = 6, 30
#: At most this share of the good documents may be rejected.
ALPHA = 0.05
GRID = [round(0.02 * k, 2) for k in range(2, 51)]
UNSPACED = re.compile(f"[{tokens.CJK}{tokens.THAI}]")


def units(normal: str) -> tuple[str, np.ndarray, int]:
    """(stratum, hashes, run length) of a text in its normal form. Texts with more Chinese, Japanese or Thai characters than
    other words are measured in characters, all others in words."""
    found = tokens.word_pattern().findall(normal)
    if normal.isascii():
        return "ascii", tokens.hashed(found), RUN
    chars = len(UNSPACED.findall(normal))
    if chars == 0:
        return ("latin" if _latin(normal) else "other"), tokens.hashed(found), RUN
    thai = len(_THAI.findall(normal))
    single = chars - thai
    # a run of Thai counts as one word above, each Chinese or Japanese character as one
    if chars > len(found) - single - len(_THAI_RUN.findall(normal)):
        held = re.sub(rf"[^{tokens.plain()}{tokens.CJK}0-9]+", "", normal)
        points = np.frombuffer(held.encode("utf-32-le"), np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            return ("thai" if thai * 2 > chars else "chinese-japanese"), (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), CHARACTERS
    return "other", tokens.hashed(found), RUN


_THAI, _THAI_RUN = re.compile(f"[{tokens.THAI}]"), re.compile(f"[{tokens.THAI}]+")


def _latin(text: str) -> bool:
    sample = [c for c in text if ord(c) > 127 and c.isalpha()]
    return sum(ord(c) < 0x250 for c in sample) * 2 >= len(sample)


def runs(hashes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the runs of `width` words that lie in one text of the joined `hashes`; equal runs of different
    texts have different hashes."""
    at = tokens.inside(lengths, width)
    text = np.repeat(np.arange(len(lengths), dtype=np.uint64), np.maximum(lengths - width + 1, 0))
    with np.errstate(over="ignore"):
        return at, tokens.rolling(hashes, width)[at] ^ (text * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def covering(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of `size` words lie in one of the runs of `width` words that begin at `starts`."""
    mark = np.zeros(size + 1, np.int32)
    mark[starts] += 1
    mark[starts + width] -= 1
    return np.cumsum(mark[:-1]) > 0


def repeated(hashes: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """For each text in the joined `hashes`, how many of its words lie in a run of at least `width` words that it held
    further up. A run may overlap its earlier copy."""
    if not len(hashes):
        return np.zeros(len(lengths), np.int64)
    at, h = runs(hashes, lengths, width)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    again = np.zeros(len(h), bool)
    again[order[1:]] = ordered[1:] == ordered[:-1]
    covered = covering(at[again], width, len(hashes))
    total = np.concatenate([[0], np.cumsum(covered)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


#: The labeller's rules, a document is good if none holds: shares of its characters in repeated paragraphs and sentences
#: (copies after the first), in the most frequent phrase (all its occurrences), and in repeated phrases.
PARAGRAPHS, SENTENCES, TOP_PHRASE, PHRASES = 0.3, 0.3, 0.16, 0.2
#: Phrase lengths in words, for scripts without spaces in characters.
TOP_WORDS, LONG_WORDS, TOP_CHARACTERS, LONG_CHARACTERS = 4, 10, 12, 40
_PARAGRAPH, _SENTENCE = re.compile(r"[\r\n]+"), re.compile(r"(?<=[.!?。！？।])\s*")


def again(parts: list[str]) -> float:
    """Share of the characters in parts that came before."""
    total = sum(map(len, parts))
    return 1 - sum(map(len, set(parts))) / total if total else 0.0


def repeats_phrases(hashes: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, top: int, long: int) -> np.ndarray:
    """For each text in the joined `hashes`, whether its most frequent phrase of `top` words or its repeated phrases of `long`
    words hold too many of its characters; `sizes` has the characters of each word."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(text, sizes, len(lengths))
    before = np.concatenate([[0], np.cumsum(sizes)])
    at, h = runs(hashes, lengths, top)
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    own = n[which] > 1
    at, n = at[own], n[which[own]]
    bad = np.zeros(len(lengths), bool)
    bad[text[at[n * (before[at + top] - before[at]) >= TOP_PHRASE * total[text[at]]]]] = True
    # a text that repeats no short phrase repeats no long one
    left = np.zeros(len(lengths), bool)
    left[text[at]] = True
    left &= ~bad
    held = left[text]
    hashes, sizes, lengths, total = hashes[held], sizes[held], lengths[left], total[left]
    at, h = runs(hashes, lengths, long)
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    covered = covering(at[n[which] > 1], long, len(hashes))
    bad[left] = np.bincount(np.repeat(np.arange(len(lengths)), lengths), sizes * covered, len(lengths)) >= 2 * PHRASES * total
    return bad


def well(normals: list[str]) -> np.ndarray:
    """The labeller, on texts in their normal form: whether each is free of repetition by rules on its paragraphs, sentences
    and phrases. It looks at units of the text and their counts, never at the score (words in runs held before). Phrases
    compare by their hashes in flat arrays, as the score does."""
    good = np.zeros(len(normals), bool)
    for i, t in enumerate(normals):
        paragraphs = again([p.strip() for p in _PARAGRAPH.split(t) if p.strip()])
        good[i] = paragraphs < PARAGRAPHS and again([s.strip() for s in _SENTENCE.split(t.replace("\n", " ")) if s.strip()]) < SENTENCES
    spaceless = np.array([not t.isascii() and len(UNSPACED.findall(t)) * 2 > len(t) for t in normals], bool)
    for own, top, long in ((good & ~spaceless, TOP_WORDS, LONG_WORDS), (good & spaceless, TOP_CHARACTERS, LONG_CHARACTERS)):
        hashes, sizes = [], []
        for i in np.flatnonzero(own):
            found = normals[i].split()
            if spaceless[i]:
                points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                with np.errstate(over="ignore"):
                    hashes.append((points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                sizes.append(np.ones(len(points), np.int64))
            else:
                hashes.append(tokens.hashed(found))
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        if sum(map(len, hashes)):
            good[own] = ~repeats_phrases(np.concatenate(hashes), np.concatenate(sizes), np.array([len(h) for h in hashes]), top, long)
    return good


def reads_well(text: str) -> bool:
    """The label of one document."""
    return bool(well([tokens.normal(text)])[0])


def shares(docs: DataFrame, key: str, text: str, label: bool = False) -> DataFrame:
    """(key, stratum, words, repeated, share, good): one row a document; good is its label by well(), null without `label`.

    share = repeated / words; 0 for null, empty and short texts. One pass over the texts in Arrow batches, no shuffle; nothing
    larger than one text (or 4 million characters) is held.
    """
    kind = dict(docs.dtypes)[key]
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, stratum string, words bigint, repeated bigint, share double, good boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tokens.groups(tokens.batches(it)):
            normals = [tokens.normal(t or "") for _, t in rows]
            parts = [units(t) for t in normals]
            n = np.array([len(h) for _, h, _ in parts], np.int64)
            rep = np.zeros(len(rows), np.int64)
            for width in (RUN, CHARACTERS):
                own = np.flatnonzero(np.array([w == width for _, _, w in parts]))
                if len(own):
                    rep[own] = repeated(np.concatenate([parts[i][1] for i in own]), n[own], width)
            share = rep / np.maximum(n, 1)
            strata = [s for s, _, _ in parts]
            del parts
            good = well(normals) if label else [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([r[0] for r in rows], strata, n, rep, share, good), arrow)], schema=arrow)

    return src.mapInArrow(measure, schema).withColumnRenamed("key", key)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials: the probability at the end of the tail in logarithms, the others from it by their ratios, away
    from the mean until they no longer add to the sum (some square roots of n, whatever k)."""
    if k >= n:
        return 1.0
    low = k <= n * p
    i = k if low else k + 1
    at = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    term = total = 1.0
    while term > total * 1e-17 and (i > 0 if low else i < n):
        term *= i * (1 - p) / ((n - i + 1) * p) if low else (n - i) * p / ((i + 1) * (1 - p))
        total += term
        i += -1 if low else 1
    return min(1.0, at * total) if low else max(0.0, 1 - at * total)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate under which k or fewer of n still have probability delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid < 1 and binomial_cdf(k, n, mid) > delta else (lo, mid)
    return hi


def cutoffs(labelled: pd.DataFrame, grid: list[float], alpha: float = ALPHA, delta: float = 0.05, strata: list[str] | None = None) -> pd.DataFrame:
    """(stratum, good, cutoff, rejected, bound, certified, pooled): for each stratum the least cutoff of the grid at which,
    with confidence 1 - delta over all strata together, at most alpha of the good documents are rejected.

    labelled has stratum, share and good, and where a row stands for several documents their number in documents.

    In a stratum, the cutoffs of the grid are tested from the strictest down, each by the exact binomial bound, and testing ends at the first that fails (fixed sequence: no further correction). Strata share
    delta evenly; one that passes the whole grid hands its part on to the others (Holm's step-down over sequences). The labels of all strata together are one
    more stratum in that correction: one with too few labels to certify even the strictest cutoff takes the pooled cutoff.
    Where that isn't certified either there is no cutoff (null): nothing may be rejected. The last row, "all", is the pooled
    one.
    """
    good = labelled.assign(documents=labelled.get("documents", 1)).loc[labelled["good"].astype(bool)]
    own = sorted(labelled["stratum"].unique()) if strata is None else strata
    held = {s: (g["share"].to_numpy(float), g["documents"].to_numpy(np.int64)) for s, g in [*((s, good.loc[good["stratum"] == s]) for s in own), ("", good)]}
    n = {s: int(documents.sum()) for s, (_, documents) in held.items()}
    over = lambda s, c: int(held[s][1][held[s][0] >= c].sum())
    order, tested = sorted(grid, reverse=True), [*own, ""]
    p = {s: {c: binomial_cdf(over(s, c), n[s], alpha) if n[s] else 1.0 for c in order} for s in tested}
    passed: list[str] = []
    while whole := [s for s in tested if s not in passed and max(p[s].values()) <= delta / (len(tested) - len(passed))]:
        passed.append(whole[0])
    level = delta / max(len(tested) - len(passed), 1)
    found = {}
    for s in tested:
        stood = order if s in passed else list(itertools.takewhile(lambda c: p[s][c] <= level, order))  # noqa: B023
        found[s] = stood[-1] if stood else None
    rows = []
    for s in tested:
        pooled = s != "" and found[s] is None and found[""] is not None
        c = found[""] if pooled else found[s]
        k = over(s, c) if c is not None else 0
        rows.append((s or "all", n[s], c, k, upper_bound(k, n[s], delta / len(tested)), c is not None and not pooled, pooled))
    return pd.DataFrame(rows, columns=["stratum", "good", "cutoff", "rejected", "bound", "certified", "pooled"]).astype({"cutoff": object})


def judged(docs: DataFrame, key: str, text: str, grid: list[float] = GRID, alpha: float = ALPHA, delta: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(measured, cutoffs): every document with its share and the cutoff of its stratum, and the table of cutoffs.

    All documents are measured and labelled, none is left out: cutoffs come from the counts of the whole corpus, summed by
    stratum, label and step of the grid (a table of bounded length, the only rows that come to the driver). `rejected` is
    therefore exact for this corpus; the bound holds for the source that it is drawn from.
    A document is rejected if share >= cutoff; a stratum without cutoff (null) rejects none.
    """
    measured, steps = cut(shares(docs, key, text, label=True)), sorted(grid)
    step = F.size(F.filter(F.array(*map(F.lit, steps)), lambda c: c <= F.col("share")))
    labelled = measured.groupBy("stratum", "good", step.alias("step")).agg(F.count("*").alias("documents")).toPandas()
    labelled["share"] = np.array([-np.inf, *steps])[labelled["step"].to_numpy(int)]
    found = cutoffs(labelled, grid, alpha, delta)
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in found.itertuples(index=False)]
    table = docs.sparkSession.createDataFrame(rows, "stratum string, good bigint, cutoff double, rejected bigint, bound double, certified boolean, pooled boolean")
    own = F.broadcast(table.select("stratum", "cutoff"))  # at most five strata, all in the table
    return measured.drop("good").join(own, "stratum", "left"), table
