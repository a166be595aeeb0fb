"""An independent layer of evidence: ontology edges between the concepts of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import best

#: Relation of each attribute, and whether its ends are swapped.
DIRECTIONS = {
    "may_treat": ("TREATED_WITH", False), "may_be_treated_by": ("TREATED_WITH", True),
    "finding_site_of": ("LOCATED_IN", False), "has_finding_site": ("LOCATED_IN", True),
    "has_causative_agent": ("CAUSED_BY", False), "causative_agent_of": ("CAUSED_BY", True),
}


def oriented_edges(raw: DataFrame, concepts: DataFrame, directions: dict[str, tuple[str, bool]] = DIRECTIONS) -> DataFrame:
    """(head_cui, tail_cui, rela, relation, sab, seq) from raw (cui1, cui2, rela, sab, seq): attributes with a direction only,
    no self loops, both concepts in `concepts` (cui), ends swapped where the direction says so; suppressed edges are left out
    where raw tells them (suppress other than N). Two semi-joins."""
    if "suppress" in raw.columns:
        raw = raw.filter("suppress = 'N'")
    table = raw.sparkSession.createDataFrame([(k, r, s) for k, (r, s) in directions.items()], "rela string, relation string, swap boolean")
    e = raw.join(F.broadcast(table), "rela").filter("cui1 <> cui2")
    e = e.join(concepts.select(F.col("cui").alias("cui1")), "cui1", "left_semi").join(concepts.select(F.col("cui").alias("cui2")), "cui2", "left_semi")
    return e.select(F.when(F.col("swap"), F.col("cui2")).otherwise(F.col("cui1")).alias("head_cui"), F.when(F.col("swap"), F.col("cui1")).otherwise(F.col("cui2")).alias("tail_cui"), "rela", "relation", "sab", "seq")


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge, by seq, of each (head, tail, relation)."""
    return best(edges, ["head_cui", "tail_cui", "relation"], ["seq"])


def by_pair(edges: DataFrame) -> DataFrame:
    """(head_cui, tail_cui, relations): all relations of a pair, sorted."""
    return edges.groupBy("head_cui", "tail_cui").agg(F.sort_array(F.collect_set("relation")).alias("relations"))


def type_prior(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(head_type, tail_type, n, prior): how dense the ontology is between entity types, as the root of its share of the
    densest pair, to 2 places. A concept has its most frequent type; ties go to the alphabetically first."""
    n = entities.filter("cui is not null").groupBy("cui", "entity_type").agg(F.count("*").alias("n"))
    modal = n.groupBy("cui").agg(F.min(F.struct((-F.col("n")).alias("m"), "entity_type"))["entity_type"].alias("t"))
    j = edges.join(modal.select(F.col("cui").alias("head_cui"), F.col("t").alias("head_type")), "head_cui").join(modal.select(F.col("cui").alias("tail_cui"), F.col("t").alias("tail_type")), "tail_cui")
    pairs = j.groupBy("head_type", "tail_type").agg(F.count("*").alias("n"))
    most = pairs.agg(F.max("n").alias("most"))  # one row
    return pairs.crossJoin(F.broadcast(most)).select("head_type", "tail_type", "n", F.round(F.sqrt(F.col("n") / F.col("most")), 2).alias("prior"))
