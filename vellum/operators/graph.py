"""Property graphs of cases: nodes, aggregated edges, validation, filtering, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import percent_encode
from .lexicon import best


def node_id(kind: str, *parts: Column | str) -> Column:
    """kind:part:part, parts percent-encoded."""
    return F.concat_ws(":", F.lit(kind), *[percent_encode((F.col(p) if isinstance(p, str) else p).cast("string")) for p in parts])


def concepts(mentions: DataFrame) -> DataFrame:
    """One node for each (case_id, cui) of mentions (case_id, cui, entity_type, start, surface): how often, the sorted types,
    the label (the surface that comes first alphabetically) and the first mention."""
    return mentions.filter("cui is not null").groupBy("case_id", "cui").agg(
        F.count("*").alias("n_mentions"), F.concat_ws(",", F.sort_array(F.collect_set("entity_type"))).alias("types"),
        F.min("surface").alias("label"), F.min("start").alias("first_start"),
    ).withColumn("node", node_id("concept", "cui"))


def aggregate(relations: DataFrame) -> DataFrame:
    """One edge for each (case_id, relation, source, target) of relations (..., score, seq, status, origin): how often, the
    status of the best-scored (the first of equals), and the origin, 'ambos' if several. Self-loops are dropped after
    aggregation, edges with an unknown end never arise."""
    e = relations.filter("source is not null and target is not null").groupBy("case_id", "relation", "source", "target").agg(
        F.count("*").alias("n"), F.min(F.struct((-F.col("score")).alias("s"), "seq", "status")).alias("b"),
        F.when(F.countDistinct("origin") > 1, "ambos").otherwise(F.min("origin")).alias("origin"),
    )
    return e.filter("source <> target").select("case_id", "relation", "source", "target", "n", F.col("b.status").alias("status"), (-F.col("b.s")).alias("score"), "origin")


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, n): repeated node ids, and edges whose source or target is no node of the case. Both 0 in a valid graph."""
    twice = nodes.groupBy("case_id", "node").agg(F.count("*").alias("k")).filter("k > 1").agg(F.count("*").alias("n")).select(F.lit("repeated node").alias("fault"), "n")
    ends = edges.select("case_id", F.explode(F.array("source", "target")).alias("node"))
    loose = ends.join(nodes.select("case_id", "node"), ["case_id", "node"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("dangling end").alias("fault"), "n")
    return twice.unionByName(loose)


def filtered(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first `most` nodes of every case, context nodes before concepts, those by count (descending), label and id, and the
    edges between them. A display limit; nodes (case_id, node, context, n_mentions, label)."""
    w = W.partitionBy("case_id").orderBy(F.desc("context"), F.desc("n_mentions"), "label", "node")
    kept = nodes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    end = lambda c: kept.select("case_id", F.col("node").alias(c))
    return kept, edges.join(end("source"), ["case_id", "source"], "left_semi").join(end("target"), ["case_id", "target"], "left_semi")


def best_relations(relations: DataFrame, keys: list[str]) -> DataFrame:
    """The best-scored relation of each key, the first by rel_id of equals."""
    return best(relations, keys, ["-score", "rel_id"])


def merged(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge with provenance: keys, origin p1, p2 or ambos, and score of two where it has one. Keys are unique and
    not null on either side."""
    a = one.select(*keys, F.col("score").alias("s1"), F.lit(True).alias("in1"))
    b = two.select(*keys, F.col("score").alias("s2"), F.lit(True).alias("in2"))
    origin = F.when(F.col("in1") & F.col("in2"), "ambos").when(F.col("in1"), "p1").otherwise("p2")
    return a.join(b, keys, "full").select(*keys, origin.alias("origin"), F.coalesce("s2", "s1").alias("score"))


def compared(both: DataFrame) -> DataFrame:
    """(relation, p1, p2, both, only_p1, only_p2, jaccard) for each relation of a merged() table and in total. One
    aggregation with grouping sets."""
    in1, in2 = F.col("origin").isin("p1", "ambos").cast("bigint"), F.col("origin").isin("p2", "ambos").cast("bigint")
    g = both.rollup("relation").agg(F.sum(in1).alias("p1"), F.sum(in2).alias("p2"), F.sum(in1 * in2).alias("both"), F.count("*").alias("either"))
    return g.select(F.coalesce("relation", F.lit("TOTAL")).alias("relation"), "p1", "p2", "both", (F.col("p1") - F.col("both")).alias("only_p1"), (F.col("p2") - F.col("both")).alias("only_p2"), F.coalesce(F.try_divide("both", "either"), F.lit(0.0)).alias("jaccard"))


def degrees(edges: DataFrame) -> DataFrame:
    """(case_id, vertices, edges, mean_degree) of the connected nodes: 2 E / V."""
    ends = edges.select("case_id", F.explode(F.array("source", "target")).alias("node")).groupBy("case_id").agg(F.countDistinct("node").alias("vertices"))
    n = edges.groupBy("case_id").agg(F.count("*").alias("edges"))
    return n.join(ends, "case_id").select("case_id", "vertices", "edges", (2.0 * F.col("edges") / F.col("vertices")).alias("mean_degree"))


def demographic_nodes(cases: DataFrame) -> DataFrame:
    """(case_id, kind, node, value): person, and age and sex where known ('' none, unknown and nan are not; age 0 is)."""
    known = lambda c: F.when(~F.lower(F.trim(F.col(c))).isin("", "none", "unknown", "nan"), F.trim(F.col(c)))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("Person", F.col("case_id")), ("Age", known("age")), ("Sex", known("gender")), ("Article", F.nullif(F.trim("article_id"), F.lit(""))))])
    rows = cases.select("case_id", F.explode(kinds).alias("k")).filter("k.value is not null")
    return rows.select("case_id", "k.kind", node_id("node", "k.kind", "k.value").alias("node"), "k.value")
