"""Measures of predicted relations against judged ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .rank import ordered


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(df: DataFrame) -> DataFrame:
    """df (tp, fp, fn, ...) with precision, recall and F1, 0 where undefined."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r, "f1": ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def judged(gold: DataFrame, predicted: DataFrame, keys: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """gold (keys, is_relation, gold_relation) with the predicted relation and score, null where none: pairs outside gold
    aren't judged. With `candidates` (keys), a judged pair that is no candidate is an error."""
    if candidates is not None and (lost := gold.join(candidates, keys, "left_anti").limit(3).collect()):
        raise ValueError(f"judged pairs that are no candidates: {lost}")
    return gold.join(predicted.select(*keys, F.col("relation").alias("predicted"), "score"), keys, "left")


def detection(j: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn of detection, and how many detected ones have the right type, by group. A judged table from judged()."""
    hit, true = F.col("predicted").isNotNull(), F.col("is_relation")
    n = lambda c: F.count_if(c)
    g = j.groupBy(*by) if by else j.groupBy()
    return prf(g.agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"), n(hit & true & (F.col("predicted") == F.col("gold_relation"))).alias("typed")))


def assertions(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(gold_assertion, hits, right, accuracy): of the judged relations (keys, is_relation, gold_assertion) that were found
    (keys, assertion), how many have the judged assertion."""
    j = gold.filter("is_relation").join(predicted.select(*keys, "assertion"), keys)
    g = j.groupBy("gold_assertion").agg(F.count("*").alias("hits"), F.count_if(F.col("assertion") == F.col("gold_assertion")).alias("right"))
    return g.withColumn("accuracy", ratio(F.col("right"), F.col("hits")))


def per_relation(j: DataFrame) -> DataFrame:
    """tp, fp, fn of each relation type: a wrong type is a miss of the gold type and a false hit of the predicted one."""
    hit, true = F.col("predicted").isNotNull(), F.col("is_relation")
    right = hit & true & (F.col("predicted") == F.col("gold_relation"))
    a = j.filter(true).select(F.col("gold_relation").alias("relation"), right.cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), (~right).cast("bigint").alias("fn"))
    b = j.filter(hit & ~right).select(F.col("predicted").alias("relation"), F.lit(0).cast("bigint").alias("tp"), F.lit(1).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn"))
    return prf(a.unionByName(b).groupBy("relation").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def confusion(j: DataFrame) -> DataFrame:
    none = F.lit("NENHUMA")
    return j.select(F.when(F.col("is_relation"), F.col("gold_relation")).otherwise(none).alias("gold"), F.coalesce("predicted", none).alias("predicted")).groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def sweep(j: DataFrame, thresholds: list[float]) -> DataFrame:
    """Detection at each threshold on the score; one pass, rows multiplied by the thresholds (few) before aggregation."""
    t = j.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return detection(t.withColumn("predicted", F.when(F.col("score") >= F.col("threshold"), F.col("predicted"))), ["threshold"])


#: Shifts and constants of MD5 (RFC 1321), and which word of the block each step reads.
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16) for i in range(64)]
#: Digests are computed for so many draws at once: the arrays stay in a core's cache.
STEP = 16384


def _halves(blocks: list[np.ndarray | int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 digests of `size` one-block messages; a word of the block that all have in common is a
    number, the others are arrays."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = blocks[_WORDS[i][turn]]
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f), np.add(f, np.uint32(_SINES[i]), out=f)
        else:
            np.add(f, np.uint32((word + _SINES[i]) & 0xFFFFFFFF), out=f)
        by = _SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - by), out=g), np.left_shift(f, np.uint32(by), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(0x67452301), b + np.uint32(0xEFCDAB89)


def drawn(b: int, first: int, last: int, n: int) -> np.ndarray:
    """Indices in 0..n-1 of the draws first..last-1 of round b, whose numbers have equally many digits: the first 12 digits of
    the hexadecimal MD5 of "b:i", modulo n."""
    i = np.arange(first, last, dtype=np.uint32 if last < 2**32 else np.uint64)
    head, digits, zero = f"{b}:".encode(), len(str(first)), len(i) * [0]
    size = len(head) + digits
    block: list[np.ndarray | int] = [0] * 16
    for at, x in [*enumerate(head), (size, 0x80)]:
        block[at // 4] += x << at % 4 * 8
    for at in range(size - 1, len(head) - 1, -1):
        i, digit = np.divmod(i, i.dtype.type(10))
        block[at // 4] = (digit.astype(np.uint32) + np.uint32(48) << np.uint32(at % 4 * 8)) + (x if isinstance(x := block[at // 4], np.ndarray) else np.uint32(x))
    block[14] = size * 8
    one, two = _halves(block, len(zero))
    h = (one.byteswap().astype(np.uint64) << np.uint64(16)) | (two.byteswap() >> np.uint32(16)).astype(np.uint64)
    return (h - h // np.uint64(n) * np.uint64(n)).astype(np.int64)


def rounds_drawn(counts: np.ndarray, rounds: list[int]) -> np.ndarray:
    """The summed rows of counts (n rows) over the n draws of each round."""
    n, out = len(counts), np.zeros((len(rounds), counts.shape[1]), np.int64)
    for k, b in enumerate(rounds):
        at, low = np.empty(n, np.int64), 0
        while low < n:
            high = min(n, low + STEP, 10 ** len(str(low)))
            at[low:high] = drawn(b, low, high, n)
            low = high
        times = np.bincount(at, minlength=n)
        for lo in range(0, n, 1 << 20):
            out[k] += times[lo : lo + (1 << 20)] @ counts[lo : lo + (1 << 20)].astype(np.int64)
    return out


def bootstrap(cases: DataFrame, rounds: int) -> DataFrame:
    """Paired bootstrap by case of cases (case_id, a_tp, a_fp, a_fn, b_tp, b_fp, b_fn): one row with the F1 difference, its
    95 % percentile interval and the share of rounds over 0.

    Draws are hashed, so every engine draws alike. Cases are numbered by their order. Their six counts, in the least type that
    holds them (some 6 bytes a case), are sent to the tasks, which share the rounds out and sum the cases that each draws;
    no draw is ever a row. Only the rounds' values (as many as asked for) are sorted.
    """
    six = [f"{x}_{c}" for x in "ab" for c in ("tp", "fp", "fn")]
    order = cut(ordered(cases, ["case_id"], "i").select("i", *[F.col(c).cast("bigint").alias(c) for c in six]))
    spark = cases.sparkSession
    top = order.agg(*[F.max(c).alias(c) for c in six]).first()
    kind = next(k for k, most in (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31), ("bigint", 2**63)) if max([0, *filter(None, top)]) < most)
    rows = order.select("i", *[F.coalesce(c, F.lit(0)).cast(kind).alias(c) for c in six]).toArrow()
    counts = np.empty((rows.num_rows, len(six)), rows.schema.field(1).type.to_pandas_dtype())
    at = rows.column("i").to_numpy()
    for k, c in enumerate(six):
        counts[at, k] = rows.column(c).to_numpy()
    del rows, at
    sent = spark.sparkContext.broadcast(counts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in rounds_drawn(sent.value, own).T], six)

    # a task of a few seconds: rounds times cases over the tasks
    parts = max(spark.sparkContext.defaultParallelism, min(rounds, rounds * len(counts) // 20_000_000))
    s = spark.range(0, rounds if len(counts) else 0, 1, parts).mapInArrow(run, ", ".join(f"{c} bigint" for c in six))
    f1 = lambda x: ratio(2.0 * F.col(f"{x}_tp"), 2 * F.col(f"{x}_tp") + F.col(f"{x}_fp") + F.col(f"{x}_fn"))
    d = s.select((f1("a") - f1("b")).alias("d")).agg(F.sort_array(F.collect_list("d")).alias("v"))
    whole = cases.agg(*[F.sum(c).alias(c) for c in six]).select((f1("a") - f1("b")).alias("difference"))
    return whole.crossJoin(d).select("difference", F.get("v", F.lit(int(0.025 * rounds))).alias("low"), F.get("v", F.lit(int(0.975 * rounds) - 1)).alias("high"), (F.size(F.filter("v", lambda x: x > 0)) / F.lit(float(rounds))).alias("over_0"))


def win_tie_loss(cases: DataFrame, a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    d = F.col(a) - F.col(b)
    return cases.agg(F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"), F.avg(a).alias("mean_a"), F.stddev_pop(a).alias("sd_a"))


def stratified(items: DataFrame, key: str, size: str, k: int) -> DataFrame:
    """k items spread over the order of (size, key): those at ranks int(i n / k)."""
    ranked = ordered(items, [size, key], "r")
    want = items.sparkSession.range(k).crossJoin(F.broadcast(items.agg(F.count("*").alias("n")))).select(F.floor(F.col("id") * F.col("n") / k).alias("r")).distinct()
    return ranked.join(F.broadcast(want), "r", "left_semi").select(key, size, "r")  # k rows
