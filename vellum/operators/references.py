"""References to records that don't exist: as-of validity, and the cascade down the foreign-key graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def reference_key(c: str | Column) -> Column:
    """Trimmed and in capitals; blank becomes null, which is no reference."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), F.lit(""))


def validity(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(ref, spans): of each normalised key, the sorted and merged half-open intervals in which it exists.

    Intervals that touch or overlap are merged, so the array holds only true gaps; a null end is open. Rows with a null key
    or start, or with an end not after the start, give no interval. One row a key, aggregated before the shuffle by distinct
    intervals.
    """
    p = parents.select(reference_key(key).alias("ref"), F.col(start).alias("s"), F.col(end).alias("e"))
    p = p.filter("ref is not null and s is not null and (e is null or e > s)")
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    p = p.groupBy("ref").agg(F.sort_array(F.collect_set(F.struct("s", F.coalesce("e", far).alias("e")))).alias("spans"))
    merged = F.aggregate(
        "spans", F.slice("spans", 1, 0),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["e"] >= x["s"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return p.select("ref", F.when(F.size("spans") > 1, merged).otherwise(F.col("spans")).alias("spans"))


def orphans(children: DataFrame, key: str, fields: dict[str, DataFrame], at: str) -> DataFrame:
    """(row_key, field_name, at, reason) for each reference that isn't valid at the row's own time.

    children has one row a key; fields maps each referring column to validity() of the table it points at. All fields of a
    table share one exchange where they point at the same parents: the references are unpivoted, then joined once. The join
    carries only (ref, row_key, at); its skew on hot references is left to a broadcast of the parents, where their measured
    size allows one, and to the split of skewed partitions otherwise. reason: absent, not yet, or taken back (a gap or the
    end). A null time makes every reference of the row invalid (absent or not yet).
    """
    parts = []
    for parents in {id(p): p for p in fields.values()}.values():
        own = [f for f, p in fields.items() if p is parents]
        refs = F.array(*[F.struct(F.lit(f).alias("field_name"), reference_key(f).alias("ref")) for f in own])
        rows = children.select(F.col(key).alias("row_key"), F.col(at).alias("at"), F.explode(refs).alias("r"))
        rows = rows.select("row_key", "at", "r.field_name", "r.ref").filter("ref is not null")
        joined = rows.join(parents, "ref", "left")
        ok = F.exists("spans", lambda x: (x["s"] <= F.col("at")) & (x["e"] > F.col("at")))
        reason = F.when(F.col("spans").isNull(), "absent").when(F.col("at").isNull() | (F.element_at("spans", 1)["s"] > F.col("at")), "not yet").otherwise("taken back")
        parts.append(joined.filter(~F.coalesce(ok, F.lit(False))).select("row_key", "field_name", "at", "ref", reason.alias("reason")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Edge:
    """A foreign key: rows of `child` (columns key, ref) refer to rows of `parent` (by its column key)."""

    child: str
    parent: str
    rows: DataFrame


def cascade(direct: DataFrame, edges: list[Edge], keep: Sequence[str] = ()) -> DataFrame:
    """(table_name, row_key, keep, depth): depth 0 for the direct orphans given in `direct` (table_name, row_key), n for rows
    whose nearest orphaned ancestor is n foreign keys up. Fixpoint: in each round, children of the rows found in the last
    round are sought by a semi-join, less those known; it ends when a round finds none, also on cyclic graphs.
    The columns `keep` of direct and of the edges' rows, which the row's key determines, are handed on.
    """
    known = cut(direct.select("table_name", F.col("row_key").cast("string").alias("row_key"), *keep).distinct().withColumn("depth", F.lit(0)))
    frontier, depth = known, 0
    while edges:
        depth, found = depth + 1, None
        for e in edges:
            hit = frontier.filter(F.col("table_name") == e.parent).select(F.col("row_key").alias("ref"))
            new = e.rows.select(F.col("key").cast("string").alias("row_key"), F.col("ref").cast("string").alias("ref"), *keep).join(hit, "ref", "left_semi").select(F.lit(e.child).alias("table_name"), "row_key", *keep)
            found = new if found is None else found.unionByName(new)
        frontier = cut(found.distinct().join(known.select("table_name", "row_key"), ["table_name", "row_key"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier))
    return known
