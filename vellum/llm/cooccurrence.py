"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

The null keeps, in expectation, how often each item occurs and how many items each basket holds: item i is in basket b with
probability x_i y_b / (1 + x_i y_b), independently. Items of one frequency share x, baskets of one size share y, so the fit
works on the table of classes, not on items or baskets. A pair's count under the null is a sum of independent unequal coins
(Poisson-binomial); its upper tail gives the p-value, Benjamini-Hochberg over all pairs that could occur gives the q-value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Frequencies and sizes up to EXACT are classes of their own; above, classes are this much wide (ratio), so their number
#: grows with the logarithm of the data: 1e12 rows give fewer than 900, and the fit is a table of 900 x 900 at most. An item
#: is scored with the parameter of its class scaled to its own frequency, so the width costs a second-order error only.
EXACT, WIDTH = 64, 1.03
#: Items of a basket meet in blocks of at most this many, so no task makes all pairs of a large basket.
BLOCK = 1024


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def baskets(df: DataFrame, key: str, items: Column) -> DataFrame:
    """(key, items): the distinct non-null items of each row; null keys and empty baskets are left out. Keys must be unique
    (operators.rank.earliest)."""
    rows = df.select(F.col(key).alias("key"), F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("items"))
    return rows.filter("key is not null and size(items) > 0")


def size_class(n: Column) -> Column:
    return F.when(n <= EXACT, n).otherwise(EXACT + F.ceil(F.log(n / F.lit(float(EXACT))) / math.log(WIDTH))).cast("int")


def pair_counts(b: DataFrame, min_count: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """(pairs, freq, n): exact counts (a, b, n_ab, n_a, n_b) of every pair with n_ab >= min_count and a < b, item frequencies
    (item, n) and the number of baskets.

    Items rarer than min_count can't be in such a pair and are dropped from the baskets first (nothing is lost). Items travel
    as dense numbers. A basket is cut into blocks of BLOCK items; two blocks (or one and itself) meet in a generator, so no
    task holds the pairs of a basket, and the meetings of baskets of several blocks are spread over all tasks. Pairs are
    summed before the shuffle, which then carries each distinct pair once a task.
    """
    n = b.count()
    freq = cut(b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    kept = freq.filter(F.col("n") >= min_count)
    ids = b.select("key", F.explode("items").alias("item")).join(kept.select("item", "id"), "item").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter("size(ids) > 1")
    one = ids.filter(F.size("ids") <= BLOCK).select(F.posexplode("ids").alias("p", "i"), "ids").select("i", F.expr("slice(ids, p + 2, size(ids))").alias("others"))
    last = F.floor((F.size("ids") - 1) / BLOCK).cast("int")
    met = ids.filter(F.size("ids") > BLOCK).select("key", "ids", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("x"))
    met = met.select("key", "ids", "x", F.explode(F.sequence("x", "last")).alias("y"))
    met = met.select("key", "x", "y", *[F.slice("ids", F.col(c) * BLOCK + 1, F.lit(BLOCK)).alias(f"{c}s") for c in "xy"]).repartition("key", "x", "y")
    many = met.select("x", "y", "ys", F.posexplode("xs").alias("p", "i")).select("i", F.expr("if(x = y, slice(ys, p + 2, size(ys)), ys)").alias("others"))
    left = one.unionByName(many).select("i", F.explode("others").alias("j"))
    counts = left.groupBy("i", "j").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    one, two = (kept.select(F.col("id").alias(i), F.col("item").alias(w), F.col("n").alias(m)) for i, w, m in (("i", "wa", "na"), ("j", "wb", "nb")))
    named = counts.join(one, "i").join(two, "j")
    first = F.col("wa") < F.col("wb")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return named.select(pick("wa", "wb").alias("a"), pick("wb", "wa").alias("b"), "n_ab", pick("na", "nb").alias("n_a"), pick("nb", "na").alias("n_b")), freq, n


def classes(df: DataFrame, value: str) -> pd.DataFrame:
    """(cls, mean, count) of a column of positive counts; as many rows as there are classes."""
    c = df.groupBy(size_class(F.col(value)).alias("cls")).agg(F.avg(value).alias("mean"), F.count("*").alias("count"))
    return c.toPandas().sort_values("cls").reset_index(drop=True)


def fit(items: pd.DataFrame, sizes: pd.DataFrame, rounds: int = 500, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """x of each item class and y of each size class, so that expected frequencies and sizes equal the given ones: fixed-point
    iteration in alternation. An item in every basket (or a basket with every item) drives its parameter up without bound;
    it is capped, which leaves its probabilities within 1e-9 of 1."""
    k, mk, s, ns = (np.asarray(v, float) for v in (items["mean"], items["count"], sizes["mean"], sizes["count"]))
    total = max(float((k * mk).sum()), 1.0)
    x, y = k / math.sqrt(total), s / math.sqrt(total)
    for _ in range(rounds):
        old = x
        x = np.minimum(k / np.maximum((ns * y / (1 + np.outer(x, y))).sum(1), 1e-300), 1e12)
        y = np.minimum(s / np.maximum(((mk * x)[:, None] / (1 + np.outer(x, y))).sum(0), 1e-300), 1e12)
        if np.max(np.abs(x - old) / np.maximum(old, 1e-300), initial=0) < tolerance:
            break
    return x, y


def tail(q: np.ndarray, n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 P(X >= c) of Poisson-binomial sums X: row r has n[s] coins of probability q[r, s].

    Saddle point with lattice correction (Lugannani-Rice), vectorised over rows; at the mean the central-limit form with
    third moment. Relative error of the tail is about 1 % for counts over 5, more for fewer; c <= 0 gives 0.
    """
    q = np.clip(q, 1e-300, 1 - 1e-12)
    mu, most = q @ n, n.sum()
    c = np.asarray(c, float)
    top = np.clip(c, 1e-9, most - 0.5)
    t = np.log(top / np.maximum(mu, 1e-300))
    for _ in range(60):
        e = q * np.exp(np.clip(t, -700, 700))[:, None]
        p = e / (1 - q + e)
        k1, k2 = p @ n, np.maximum((p * (1 - p)) @ n, 1e-300)
        step = np.clip((k1 - top) / k2, -1, 1)
        t = t - step
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    e = q * np.exp(np.clip(t, -700, 700))[:, None]
    p = e / (1 - q + e)
    k2 = np.maximum((p * (1 - p)) @ n, 1e-300)
    cumulant = np.log1p(q * np.expm1(np.clip(t, -700, 700))[:, None]) @ n
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * top - cumulant), 0))
    u = -np.expm1(-t) * np.sqrt(k2)
    phi = np.exp(-w * w / 2) / math.sqrt(2 * math.pi)
    upper = 0.5 * np.vectorize(math.erfc, otypes=[float])(w / math.sqrt(2))
    with np.errstate(all="ignore"):
        near = np.abs(w) < 1e-4
        sigma2, mu3 = (q * (1 - q)) @ n, (q * (1 - q) * (1 - 2 * q)) @ n
        centre = 0.5 + mu3 / (6 * math.sqrt(2 * math.pi) * np.maximum(sigma2, 1e-300) ** 1.5) + 0.5 / np.sqrt(2 * math.pi * np.maximum(sigma2, 1e-300))
        value = np.where(near, centre, upper + phi * (1 / u - 1 / w))
        # far out the normal density underflows: the leading term in logarithms
        far = (-w * w / 2 - np.log(np.maximum(u, 1e-300)) - 0.5 * math.log(2 * math.pi)) / math.log(10)
        out = np.where((w > 30) | ~(value > 0), far, np.log10(np.clip(value, 1e-300, 1)))
    return np.where(c <= 0, 0.0, np.minimum(out, 0.0))


def surprise(b: DataFrame, min_count: int = 1) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n, pmi, llr, expected, log10_p, q_value) of every pair with n_ab >= min_count.

    pmi = log2(n_ab n / (n_a n_b)); llr is Dunning's. The p-value depends on the classes of both items, on how their
    frequencies stand to the means of their classes (rounded to 0.1 %) and on the count, so it is computed once for each
    distinct combination, in Arrow batches. q_value is Benjamini-Hochberg over all
    V (V - 1) / 2 pairs of the vocabulary; pairs under min_count aren't tested and rank behind, which can only raise q.
    Ranks come from the table of distinct p-values (rounded to 6 digits of log10), not from one sorted partition.
    Empty input gives no rows; one basket or one item gives no pairs or p-values near 1.
    """
    b = cut(b)
    pairs, freq, n = pair_counts(b, min_count)
    items, sizes = classes(freq, "n"), classes(b.select(F.size("items").alias("s")), "s")
    means = F.broadcast(freq.sparkSession.createDataFrame([(int(c), float(m)) for c, m in zip(items["cls"], items["mean"])], "cls int, mean double"))  # a row a class
    own = lambda c, f: means.select(F.col("cls").alias(c), F.col("mean").alias(f))
    pairs = pairs.withColumn("ca", size_class(F.least("n_a", "n_b"))).withColumn("cb", size_class(F.greatest("n_a", "n_b"))).join(own("ca", "ma"), "ca").join(own("cb", "mb"), "cb")
    # x_i is proportional to the frequency where probabilities are small: the product of both corrections scales the pair
    pairs = cut(pairs.withColumn("lift", F.round(F.col("n_a") * F.col("n_b") / (F.col("ma") * F.col("mb")), 3)).drop("ma", "mb"))
    vocabulary = int(items["count"].sum())
    x, y = fit(items, sizes)
    ns, code = np.asarray(sizes["count"], float), np.asarray(items["cls"])
    tests = max(vocabulary * (vocabulary - 1) / 2, 1.0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096].copy()
                xa, xb = (x[np.searchsorted(code, part[c].to_numpy())] for c in ("ca", "cb"))
                oa, ob = np.outer(xa, y), np.outer(xb, y)
                q = np.minimum(oa / (1 + oa) * ob / (1 + ob) * part["lift"].to_numpy()[:, None], 1.0)
                part["expected"], part["log10_p"] = q @ ns, tail(q, ns, part["n_ab"].to_numpy()).round(6)
                yield part

    triples = pairs.groupBy("ca", "cb", "lift", "n_ab").agg(F.count("*").alias("m"))
    scored = cut(triples.mapInPandas(score, "ca int, cb int, lift double, n_ab bigint, m bigint, expected double, log10_p double"))
    ranks = step_up(scored, tests)
    h = lambda *v: sum((F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / F.lit(float(max(n, 1))))).otherwise(0.0) for c in v), F.lit(0.0))
    cells = {"k11": F.col("n_ab"), "k12": F.col("n_a") - F.col("n_ab"), "k21": F.col("n_b") - F.col("n_ab"), "k22": n - F.col("n_a") - F.col("n_b") + F.col("n_ab"), "na_": n - F.col("n_a"), "nb_": n - F.col("n_b")}
    out = pairs.join(scored.drop("m"), ["ca", "cb", "lift", "n_ab"]).join(ranks, "log10_p").withColumns(cells)
    llr = 2 * (h("k11", "k12", "k21", "k22") - h("n_a", "na_") - h("n_b", "nb_"))
    pmi = F.log2(F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b")))
    return out.select("a", "b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), pmi.alias("pmi"), llr.alias("llr"), "expected", "log10_p", "q_value")


def step_up(scored: DataFrame, tests: float) -> DataFrame:
    """(log10_p, q_value): Benjamini-Hochberg from counts m of each distinct log10_p. Ranks are prefix sums over blocks of
    p-values, then within blocks, so no task sorts all values. Blocks widen in proportion to |log10_p|."""
    p = scored.groupBy("log10_p").agg(F.sum("m").alias("m")).withColumn("block", -F.ceil(256 * F.log1p(-F.col("log10_p"))))
    # one row a block: 256 for each factor e of |log10_p|, so at most some 9,000 whatever the data
    blocks = p.groupBy("block").agg(F.sum("m").alias("bm"))
    before = blocks.select("block", F.coalesce(F.sum("bm").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("m").over(W.partitionBy("block").orderBy("log10_p"))
    ranked = p.join(before, "block").withColumn("rank", F.col("before") + inside)
    ranked = ranked.withColumn("raw", F.least(F.lit(1.0), F.pow(F.lit(10.0), "log10_p") * tests / F.col("rank")))
    least = ranked.groupBy("block").agg(F.min("raw").alias("bmin"))
    after = least.select("block", F.min("bmin").over(W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)).alias("after"))
    own = F.min("raw").over(W.partitionBy("block").orderBy(F.desc("log10_p")))
    return ranked.join(after, "block").select("log10_p", F.least(own, F.coalesce("after", F.lit(1.0))).alias("q_value"))
