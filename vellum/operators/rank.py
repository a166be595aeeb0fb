"""Ranks within groups of any size, and the earliest delivery of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

#: A bucket of group_rank holds about this many rows, however many there are.
BUCKET_ROWS = 500_000
LEAST_BUCKETS = 64
#: Up to so many repeated keys are broadcast (a key is some 30 bytes); more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def group_rank(df: DataFrame, key: str, by: Sequence[str], out: str = "rank", rows: int = 0) -> DataFrame:
    """0-based position of each row in its `key` group, without one task ever holding a group.

    `rows` is the number of rows, where the caller has counted them: a group is spread over rows / BUCKET_ROWS buckets by the hash of the `by` columns
    (which should identify the row), ranked there, and shifted by the number of rows in its earlier buckets, so parallelism
    grows with the data; the table of counts has a row for each group and each of its buckets that holds any.
    The order is by bucket, then by `by`: fixed for given rows, but not the order of `by` itself.
    Null keys form a group. Rows equal in all `by` columns share a bucket and get different ranks.
    """
    b, n, shift = "__bucket", "__n", "__shift"
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    spread = df.withColumn(b, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    counts = spread.groupBy(key, b).agg(F.count("*").alias(n))
    before = W.partitionBy(key).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(F.col(key).alias("__k"), F.col(b).alias("__b"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(shift))
    within = spread.withColumn(out, F.row_number().over(W.partitionBy(key, b).orderBy(*by)) - 1)
    joined = within.join(shifts, F.col(key).eqNullSafe(F.col("__k")) & (F.col(b) == F.col("__b")))
    return joined.withColumn(out, F.col(out) + F.col(shift)).drop(b, "__k", "__b", shift)


def earliest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """(key, at, columns): one row a key, its earliest delivery by `at`. Null times come last, ties go to the smallest row,
    rows with a null key count as one key. Columns must be orderable (no maps). Aggregates before the shuffle, so a key
    delivered any number of times costs one row a task.
    """
    row = F.struct(F.col(at).isNull().alias("_late"), F.col(at).alias("_at"), *columns)
    best = df.groupBy(key).agg(F.min(row).alias("_row"))
    return best.select(key, F.col("_row._at").alias(at), *[F.col(f"_row.{c}").alias(c) for c in columns])


def earliest_text(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """What earliest() gives, for tables with long columns: no long column is shuffled but those of repeated keys.

    Keys delivered more than once are counted from the key column alone. Rows of other keys pass as they are, those of
    repeated keys go through earliest(). The repeated keys are broadcast up to BROADCAST_KEYS of them (counted first), beyond
    that they are joined by a shuffle.
    """
    wide = df.select(key, at, *columns)
    again = df.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col(key).alias("__k"))
    if again.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        again = F.broadcast(again)
    same = F.col(key).eqNullSafe(F.col("__k"))
    once = wide.join(again, same, "left_anti")
    return once.unionByName(earliest(wide.join(again, same, "left_semi"), key, at, *columns))


def ordered(df: DataFrame, by: Sequence[str], out: str = "rank") -> DataFrame:
    """0-based position of each row in the order of `by` over all rows (ties in any order). Rows are sorted in ranges, each
    ranked by itself and shifted by the rows of the ranges before it, so no task holds them all; the table of ranges has a
    row a partition. The sorted rows are written once, as positions must not change between reads."""
    part = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    shifts = part.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    ranked = part.withColumn(out, F.row_number().over(W.partitionBy("__p").orderBy(*by)) - 1).join(F.broadcast(shifts), "__p")
    return ranked.withColumn(out, F.col(out) + F.col("__shift")).drop("__p", "__shift")
