"""Queries of the ontology layer, graphs and set comparison, on the delivered relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, lexicon, ontology
from ..operators.rank import earliest
from ..operators.references import reference_key
from ..session import table
from ..sources import sinks
from . import tables as tb

#: Direction of the delivered attributes.
DIRECTIONS = {"may_be_treated_by": ("TREATED_WITH", True), "has_site": ("LOCATED_IN", False), "due_to": ("CAUSED_BY", True), "has_sign": ("HAS_SYMPTOM", False), "shown_by": ("REVEALED_BY", False)}
KEY = ["case_id", "head_start", "tail_start", "relation"]


def corpus_concepts(spark: SparkSession, d: str) -> DataFrame:
    return tb.mentions(spark, d).select("cui").distinct()


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    e = earliest(table(spark, d, "umls_relations"), "edge_id", "loaded_at", "head_cui", "tail_cui", "rela", "sab")
    return e.select(reference_key("head_cui").alias("cui1"), reference_key("tail_cui").alias("cui2"), "rela", "sab", F.col("edge_id").alias("seq"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return ontology.first_edges(ontology.oriented_edges(raw_edges(spark, d), corpus_concepts(spark, d), DIRECTIONS))


def o1_concepts(spark: SparkSession, d: str) -> DataFrame:
    return corpus_concepts(spark, d)


def o2_edges(spark: SparkSession, d: str) -> DataFrame:
    return ontology.oriented_edges(raw_edges(spark, d), corpus_concepts(spark, d), DIRECTIONS).select("head_cui", "tail_cui", "relation", "seq")


def o3_first_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("head_cui", "tail_cui", "relation", "rela", "sab", "seq")


def o4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ontology.by_pair(edges(spark, d)).select("head_cui", "tail_cui", F.concat_ws("|", "relations").alias("relations"))


def o5_type_prior(spark: SparkSession, d: str) -> DataFrame:
    return ontology.type_prior(edges(spark, d), tb.mentions(spark, d))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.concepts(tb.mentions(spark, d))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    r = tb.relations(spark, d, ["case_id", "relation", "assertion_status", "head_kind", "head_cui", "tail_cui", "score", "rule_path"])
    source = F.when(F.col("head_kind") == "Person", graph.node_id("node", F.lit("Person"), "case_id")).otherwise(F.when(F.col("head_cui").isNotNull(), graph.node_id("concept", "head_cui")))
    target = F.when(F.col("tail_cui").isNotNull(), graph.node_id("concept", "tail_cui"))
    origin = F.when(F.array_contains("rule_path", "clause"), "p2").otherwise("p1")
    return graph.aggregate(r.select("case_id", "relation", source.alias("source"), target.alias("target"), "score", F.col("rel_id").alias("seq"), F.col("assertion_status").alias("status"), origin.alias("origin")))


def all_nodes(spark: SparkSession, d: str) -> DataFrame:
    people = tb.relations(spark, d, ["case_id"]).select("case_id").distinct().select("case_id", graph.node_id("node", F.lit("Person"), "case_id").alias("node"), F.lit(True).alias("context"), F.lit(0).cast("bigint").alias("n_mentions"), F.col("case_id").alias("label"))
    return people.unionByName(nodes(spark, d).select("case_id", "node", F.lit(False).alias("context"), "n_mentions", "label"))


def h1_ids(spark: SparkSession, d: str) -> DataFrame:
    return tb.gazetteer(spark, d).select("term_norm").distinct().select("term_norm", graph.node_id("term", "term_norm").alias("node"))


def h2_hashes(spark: SparkSession, d: str) -> DataFrame:
    return tb.cases(spark, d, ["case_text"]).select("case_id", F.sha2("case_text", 256).alias("text_sha256"))


def h4_concepts(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d)


def h4_details(spark: SparkSession, d: str) -> DataFrame:
    """What the dictionary knows of each concept node: its semantic types and vocabularies, the label (a preferred term where
    there is one, else the first term), and the spans of all its mentions."""
    g = tb.gazetteer(spark, d)
    known = g.groupBy("cui").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("tui"))).alias("tuis"), F.concat_ws(",", F.sort_array(F.collect_set("vocabulary"))).alias("vocabularies"),
        F.min(F.struct((F.coalesce(F.col("tty"), F.lit("")) != "PT").alias("other"), "term_norm"))["term_norm"].alias("label"),
    )
    spans = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", "end"))), lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    return tb.mentions(spark, d).groupBy("case_id", "cui").agg(spans.alias("evidence")).join(known, "cui", "left").select("case_id", "cui", "label", "tuis", "vocabularies", "evidence")


def h4_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """One node an occurrence: the other mode of the graph."""
    return tb.mentions(spark, d).select("case_id", "cui", "start", "end", graph.node_id("mention", "start", "end", "cui").alias("node"), "surface").distinct()


def h5_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = tb.mentions(spark, d).groupBy("case_id", "cui", "entity_type")
    spans = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", "end"))), lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    return m.agg(F.count("*").alias("n"), F.concat_ws("|", F.sort_array(F.collect_set("surface"))).alias("surfaces"), spans.alias("spans"))


def h6_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_edges(spark, d)


def h6_triggers(spark: SparkSession, d: str) -> DataFrame:
    """The trigger of the best-scored relation behind each edge, the first of equals."""
    r = tb.relations(spark, d, ["case_id", "relation", "head_kind", "head_cui", "tail_cui", "score", "trigger_text", "trigger_category"])
    r = r.filter("tail_cui is not null and (head_kind = 'Person' or head_cui is not null)").withColumn("head", F.when(F.col("head_kind") == "Person", "person").otherwise(F.col("head_cui")))
    return lexicon.best(r, ["case_id", "relation", "head", "tail_cui"], ["-score", "rel_id"]).select("case_id", "relation", "head", F.col("tail_cui").alias("tail"), "trigger_text", "trigger_category")


def h6_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Relations that give no edge, by case and reason: an end without a concept, or both ends the same."""
    r = tb.relations(spark, d, ["case_id", "head_kind", "head_cui", "tail_cui"])
    why = F.when(F.col("tail_cui").isNull(), "tail without concept").when((F.col("head_kind") != "Person") & F.col("head_cui").isNull(), "head without concept").when((F.col("head_kind") != "Person") & (F.col("head_cui") == F.col("tail_cui")), "self loop")
    return r.withColumn("warning", why).filter("warning is not null").groupBy("case_id", "warning").agg(F.count("*").alias("n"))


def h7_ontology_edges(spark: SparkSession, d: str) -> DataFrame:
    """Ontology edges between concepts of one case, with ids of their own and their source."""
    n = nodes(spark, d)
    a, b = n.select("case_id", F.col("cui").alias("head_cui")), n.select("case_id", F.col("cui").alias("tail_cui"))
    e = edges(spark, d).join(a, "head_cui").join(b, ["case_id", "tail_cui"])
    return e.select("case_id", "head_cui", "tail_cui", "relation", graph.node_id("edge", "relation", "head_cui", "tail_cui", F.lit("umls")).alias("edge"), F.coalesce("sab", F.lit("")).alias("evidence_source"))


def h9_demographics(spark: SparkSession, d: str) -> DataFrame:
    return graph.demographic_nodes(tb.cases(spark, d, ["article_id", "age", "gender"]))


def h10_faults(spark: SparkSession, d: str) -> DataFrame:
    """Both 0: no node twice, no edge with a loose end."""
    return graph.faults(all_nodes(spark, d), graph_edges(spark, d))


def h11_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Edges left when every case shows 8 nodes."""
    return graph.filtered(all_nodes(spark, d), graph_edges(spark, d), 8)[1].select("case_id", "relation", "source", "target", "n")


def h11_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Of every case with more than 8 nodes, how many the limit hides when only symptoms, diagnoses and treatments are asked for
    beside the patient."""
    shown = F.col("context") | F.arrays_overlap(F.split("types", ","), F.array(F.lit("Symptom"), F.lit("Diagnosis"), F.lit("Treatment")))
    people = all_nodes(spark, d).filter("context").withColumn("types", F.lit(""))
    every = people.unionByName(nodes(spark, d).select("case_id", "node", F.lit(False).alias("context"), "n_mentions", "label", "types")).filter(shown)
    return every.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 8").select("case_id", F.lit(8).cast("bigint").alias("shown"), (F.col("n") - 8).alias("hidden"))


def h13_types(spark: SparkSession, d: str) -> DataFrame:
    """IS_A edges from concepts to their types."""
    return tb.mentions(spark, d).select("case_id", graph.node_id("concept", "cui").alias("source"), graph.node_id("type", "entity_type").alias("target")).distinct()


def keyed(spark: SparkSession, d: str) -> DataFrame:
    r = tb.relations(spark, d, ["case_id", "relation", "head_start", "tail_start", "score", "rule_path", "token_gap", "assertion_status", "head_entity_type", "tail_entity_type", "trigger_category"])
    return graph.best_relations(r, KEY)


def h15_best(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).select(*KEY, "score", "rel_id")


def provenance(spark: SparkSession, d: str) -> DataFrame:
    k = keyed(spark, d)
    return graph.merged(k.filter("score >= 1.0"), k.filter(F.array_contains("rule_path", "clause") | (F.col("score") >= 3)), KEY)


def h16_merged(spark: SparkSession, d: str) -> DataFrame:
    return provenance(spark, d)


def h17_compared(spark: SparkSession, d: str) -> DataFrame:
    return graph.compared(provenance(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


def h18_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph_edges(spark, d)).withColumn("mean_degree", F.round("mean_degree", 6))


def h12_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each case's graph in canonical JSON."""
    n = all_nodes(spark, d).select("case_id", "node", "label", "n_mentions")
    return sinks.fingerprints(sinks.graph_json(n, graph_edges(spark, d).select("case_id", "source", "target", "relation", "n", "status")))


def h19_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The spans behind every edge of the graph."""
    r = tb.relations(spark, d, ["case_id", "relation", "head_kind", "head_cui", "tail_cui", "head_start", "head_end", "tail_start", "tail_end"])
    r = r.filter("tail_cui is not null and (head_kind = 'Person' or head_cui is not null)")
    spans = F.array_sort(F.collect_set(F.concat_ws("-", "head_start", "head_end", "tail_start", "tail_end")))
    return r.groupBy("case_id", "relation", F.coalesce("head_cui", F.lit("person")).alias("head"), F.col("tail_cui").alias("tail")).agg(F.count("*").alias("n"), F.array_join(spans, " ").alias("spans"))



def a1_types(spark: SparkSession, d: str) -> DataFrame:
    return tb.mentions(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("cui").alias("n_cuis"))


def a2_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Assertions by relation, one column each."""
    states = ["affirmed", "negated", "hedged", "historical", "family", "not_assessed"]
    return tb.relations(spark, d, ["relation", "assertion_status"]).groupBy("relation").pivot("assertion_status", states).agg(F.count(F.lit(1))).na.fill(0)


def a3_case_sets(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each case in one, both or either set."""
    o = F.col("origin")
    return provenance(spark, d).groupBy("case_id").agg(F.count_if(o == "p1").alias("only_p1"), F.count_if(o == "p2").alias("only_p2"), F.count_if(o == "ambos").alias("both"))


def a8_shared_findings(spark: SparkSession, d: str) -> DataFrame:
    """How many cases share each concept with another, and the two-hop pairs they make, counted without making them."""
    n = nodes(spark, d).groupBy("cui").agg(F.count("*").alias("cases"))
    return n.filter("cases > 1").select("cui", "cases", (F.col("cases") * (F.col("cases") - 1) / 2).cast("bigint").alias("pairs"))


def a8_treatments(spark: SparkSession, d: str) -> DataFrame:
    """Diagnoses and the treatments related to them, over cases."""
    r = tb.relations(spark, d, ["case_id", "head_cui", "tail_cui", "head_entity_type", "tail_entity_type"])
    return r.filter("head_entity_type = 'Diagnosis' and tail_entity_type = 'Treatment' and head_cui is not null and tail_cui is not null").groupBy("head_cui", "tail_cui").agg(F.countDistinct("case_id").alias("n_cases"), F.count("*").alias("n"))


def a8_demographics(spark: SparkSession, d: str) -> DataFrame:
    """Cases by gender and decade of age, with subtotals."""
    decade = (F.floor(F.expr("try_cast(age as double)") / 10) * 10).cast("int")
    return tb.cases(spark, d, ["age", "gender"]).select(F.coalesce("gender", F.lit("?")).alias("gender"), F.coalesce(decade, F.lit(-1)).alias("decade")).cube("gender", "decade").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def a6_relations(spark: SparkSession, d: str) -> DataFrame:
    """The table of negated relations between concepts, with numbers as numbers (null where there are none)."""
    r = tb.relations(spark, d, ["case_id", "relation", "assertion_status", "head_kind", "head_start", "tail_start", "trigger_start", "score"])
    return r.filter("assertion_status = 'negated' and head_kind <> 'Person'").select("rel_id", "case_id", "relation", F.expr("try_cast(head_start as bigint)").alias("head_start"), F.expr("try_cast(tail_start as bigint)").alias("tail_start"), F.expr("try_cast(trigger_start as bigint)").alias("trigger_start"), F.round("score", 3).alias("score"))


def a8_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Concepts with how often they are affirmed and negated as tails."""
    r = tb.relations(spark, d, ["tail_cui", "assertion_status"]).filter("tail_cui is not null")
    return r.groupBy("tail_cui").agg(F.count_if(F.col("assertion_status") == "affirmed").alias("affirmed"), F.count_if(F.col("assertion_status") == "negated").alias("negated"))


def a8_text_and_ontology(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of concepts related in texts, in the ontology or in both, by relation."""
    r = tb.relations(spark, d, ["relation", "head_kind", "head_cui", "tail_cui"]).filter("head_kind <> 'Person' and head_cui is not null and tail_cui is not null").select("head_cui", "tail_cui", "relation").distinct().withColumn("t", F.lit(1))
    o = edges(spark, d).select("head_cui", "tail_cui", "relation").withColumn("o", F.lit(1))
    j = r.join(o, ["head_cui", "tail_cui", "relation"], "full")
    return j.groupBy("relation").agg(F.count_if(F.col("t").isNotNull() & F.col("o").isNull()).alias("text_only"), F.count_if(F.col("t").isNull()).alias("ontology_only"), F.count_if(F.col("t").isNotNull() & F.col("o").isNotNull()).alias("both"))


def a8_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Share of mentions by vocabulary of the concept."""
    v = tb.gazetteer(spark, d).select("cui", "vocabulary").distinct()
    n = tb.mentions(spark, d).join(v, "cui").groupBy("vocabulary").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("vocabulary", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


ENC = "replace(replace(url_encode({0}), '+', '%20'), '*', '%2A')"
DIR = ", ".join(f"('{k}', '{r}', {str(s).lower()})" for k, (r, s) in DIRECTIONS.items())
EDGES_SQL = tb.sql("r", "o", "e") + f""", k AS (SELECT DISTINCT cui FROM o), d(rela, relation2, swap) AS (VALUES {DIR}),
    x AS (SELECT CASE WHEN swap THEN tail_cui ELSE head_cui END h, CASE WHEN swap THEN head_cui ELSE tail_cui END t, e.rela, relation2 relation, sab, edge_id seq FROM e JOIN d ON d.rela = e.rela
        WHERE head_cui <> tail_cui AND head_cui IN (SELECT cui FROM k) AND tail_cui IN (SELECT cui FROM k)),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY h, t, relation ORDER BY seq) = 1)"""
NODES_SQL = tb.sql("r", "o") + """, n AS (SELECT case_id, cui, count(*) n_mentions, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) types, min(surface) label, min(start) first_start, 'concept:' || cui node FROM o GROUP BY case_id, cui)"""
GRAPH_SQL = NODES_SQL + """, s AS (SELECT rel_id seq, case_id, relation, CASE WHEN head_kind = 'Person' THEN 'node:Person:' || case_id WHEN head_cui IS NOT NULL THEN 'concept:' || head_cui END source,
        CASE WHEN tail_cui IS NOT NULL THEN 'concept:' || tail_cui END target, score, assertion_status status, CASE WHEN list_contains(rule_path, 'clause') THEN 'p2' ELSE 'p1' END origin FROM r),
    q AS (SELECT case_id, relation, source, target, count(*) n, (array_agg(status ORDER BY score DESC, seq))[1] status, max(score) score, CASE WHEN count(DISTINCT origin) > 1 THEN 'ambos' ELSE min(origin) END origin
        FROM s WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL HAVING source <> target)"""
ALL_SQL = GRAPH_SQL + """, a AS (SELECT DISTINCT case_id, 'node:Person:' || case_id node, true context, 0 n_mentions, case_id label FROM r UNION ALL SELECT case_id, node, false, n_mentions, label FROM n)"""
KEYED_SQL = tb.sql("r") + """, k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY case_id, head_start, tail_start, relation ORDER BY score DESC, rel_id) = 1),
    p AS (SELECT case_id, head_start, tail_start, relation, score, score >= 1.0 a, list_contains(rule_path, 'clause') OR score >= 3 b FROM k),
    v AS (SELECT case_id, head_start, tail_start, relation, CASE WHEN a AND b THEN 'ambos' WHEN a THEN 'p1' ELSE 'p2' END origin, score FROM p WHERE a OR b)"""
CMP = "count(*) FILTER (WHERE origin <> 'p2') p1, count(*) FILTER (WHERE origin <> 'p1') p2, count(*) FILTER (WHERE origin = 'ambos') AS \"both\", count(*) FILTER (WHERE origin = 'p1') only_p1, count(*) FILTER (WHERE origin = 'p2') only_p2, round(count(*) FILTER (WHERE origin = 'ambos') / count(*), 6) jaccard"
SQL = {
    "o1_concepts": tb.sql("r", "o") + "SELECT DISTINCT cui FROM o",
    "o2_edges": EDGES_SQL + "SELECT h head_cui, t tail_cui, relation, seq FROM x",
    "o3_first_edges": EDGES_SQL + "SELECT h head_cui, t tail_cui, relation, rela, sab, seq FROM y",
    "o4_pairs": EDGES_SQL + "SELECT h head_cui, t tail_cui, string_agg(relation, '|' ORDER BY relation) relations FROM y GROUP BY ALL",
    "o5_type_prior": EDGES_SQL + """, z AS (SELECT cui, entity_type FROM (SELECT cui, entity_type, count(*) k FROM o GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cui ORDER BY k DESC, entity_type) = 1),
        w AS (SELECT a.entity_type head_type, b.entity_type tail_type, count(*) n FROM y JOIN z a ON a.cui = h JOIN z b ON b.cui = t GROUP BY ALL) SELECT *, round(sqrt(n / max(n) OVER ()), 2) prior FROM w""",
    "h1_ids": tb.sql("g") + f"SELECT DISTINCT term_norm, 'term:' || {ENC.format('term_norm')} node FROM g",
    "h2_hashes": tb.sql("c") + "SELECT case_id, sha256(case_text) text_sha256 FROM c",
    "h4_concepts": NODES_SQL + "SELECT * FROM n",
    "h4_details": tb.sql("r", "o", "g") + """, k AS (SELECT cui, string_agg(DISTINCT tui, ',' ORDER BY tui) tuis, string_agg(DISTINCT vocabulary, ',' ORDER BY vocabulary) vocabularies FROM g GROUP BY cui),
        l AS (SELECT cui, term_norm label FROM g QUALIFY row_number() OVER (PARTITION BY cui ORDER BY coalesce(tty, '') <> 'PT', term_norm NULLS FIRST) = 1), q AS (SELECT DISTINCT case_id, cui, start, "end" FROM o)
        SELECT case_id, q.cui, any_value(label) label, any_value(tuis) tuis, any_value(vocabularies) vocabularies, string_agg(start || '-' || "end", ' ' ORDER BY start, "end") evidence FROM q LEFT JOIN k USING (cui) LEFT JOIN l USING (cui) GROUP BY case_id, q.cui""",
    "h4_occurrences": tb.sql("r", "o") + """SELECT DISTINCT case_id, cui, start, "end", 'mention:' || start || ':' || "end" || ':' || cui node, surface FROM o""",
    "h5_mentions": tb.sql("r", "o") + """, q AS (SELECT DISTINCT case_id, cui, entity_type, start, "end" FROM o), z AS (SELECT case_id, cui, entity_type, string_agg(start || '-' || "end", ' ' ORDER BY start, "end") spans FROM q GROUP BY ALL)
        SELECT case_id, cui, entity_type, count(*) n, string_agg(DISTINCT surface, '|' ORDER BY surface) surfaces, any_value(spans) spans FROM o JOIN z USING (case_id, cui, entity_type) GROUP BY ALL""",
    "h6_triggers": tb.sql("r") + """SELECT case_id, relation, CASE WHEN head_kind = 'Person' THEN 'person' ELSE head_cui END head, tail_cui tail, trigger_text, trigger_category FROM r WHERE tail_cui IS NOT NULL AND (head_kind = 'Person' OR head_cui IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY case_id, relation, CASE WHEN head_kind = 'Person' THEN 'person' ELSE head_cui END, tail_cui ORDER BY score DESC, rel_id) = 1""",
    "h6_warnings": tb.sql("r") + """SELECT case_id, CASE WHEN tail_cui IS NULL THEN 'tail without concept' WHEN head_kind <> 'Person' AND head_cui IS NULL THEN 'head without concept' WHEN head_kind <> 'Person' AND head_cui = tail_cui THEN 'self loop' END warning, count(*) n FROM r GROUP BY ALL HAVING warning IS NOT NULL""",
    "h11_hidden": ALL_SQL + """, w AS (SELECT case_id FROM a WHERE context UNION ALL SELECT case_id FROM n WHERE list_has_any(string_split(types, ','), ['Symptom', 'Diagnosis', 'Treatment'])) SELECT case_id, 8::bigint shown, count(*) - 8 hidden FROM w GROUP BY case_id HAVING count(*) > 8""",
    "a6_relations": tb.sql("r") + "SELECT rel_id, case_id, relation, head_start::bigint head_start, tail_start::bigint tail_start, trigger_start::bigint trigger_start, round(score, 3) score FROM r WHERE assertion_status = 'negated' AND head_kind <> 'Person'",
    "a8_assertions": tb.sql("r") + "SELECT tail_cui, count(*) FILTER (WHERE assertion_status = 'affirmed') affirmed, count(*) FILTER (WHERE assertion_status = 'negated') negated FROM r WHERE tail_cui IS NOT NULL GROUP BY ALL",
    "a8_text_and_ontology": EDGES_SQL + """, a AS (SELECT DISTINCT head_cui h, tail_cui t, relation, 1 x FROM r WHERE head_kind <> 'Person' AND head_cui IS NOT NULL AND tail_cui IS NOT NULL), b AS (SELECT h, t, relation, 1 z FROM y), j AS (SELECT * FROM a FULL JOIN b USING (h, t, relation))
        SELECT relation, count(*) FILTER (WHERE x IS NOT NULL AND z IS NULL) text_only, count(*) FILTER (WHERE x IS NULL) ontology_only, count(*) FILTER (WHERE x IS NOT NULL AND z IS NOT NULL) AS "both" FROM j GROUP BY relation""",
    "h6_edges": GRAPH_SQL + "SELECT * FROM q",
    "h7_ontology_edges": EDGES_SQL + ", n AS (SELECT DISTINCT case_id, cui FROM o) SELECT a.case_id, h head_cui, t tail_cui, relation, 'edge:' || relation || ':' || h || ':' || t || ':umls' edge, coalesce(sab, '') evidence_source FROM y JOIN n a ON a.cui = h JOIN n b ON b.cui = t AND b.case_id = a.case_id",
    "h9_demographics": tb.sql("c") + f""", k AS (SELECT case_id, 'Person' kind, case_id "value" FROM c UNION ALL SELECT case_id, 'Age', trim(age) FROM c WHERE lower(trim(age)) NOT IN ('', 'none', 'unknown', 'nan')
        UNION ALL SELECT case_id, 'Sex', trim(gender) FROM c WHERE lower(trim(gender)) NOT IN ('', 'none', 'unknown', 'nan') UNION ALL SELECT case_id, 'Article', trim(article_id) FROM c WHERE trim(article_id) <> '')
        SELECT case_id, kind, 'node:' || kind || ':' || {ENC.format('"value"')} node, "value" FROM k""",
    "h10_faults": ALL_SQL + "SELECT 'repeated node' fault, count(*) n FROM (SELECT 1 FROM a GROUP BY case_id, node HAVING count(*) > 1) UNION ALL SELECT 'dangling end', count(*) FROM (SELECT case_id, source node FROM q UNION ALL SELECT case_id, target FROM q) ANTI JOIN a USING (case_id, node)",
    "h11_filtered": ALL_SQL + ", f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY context DESC, n_mentions DESC, label, node) <= 8) SELECT q.case_id, relation, source, target, n FROM q SEMI JOIN f s ON s.case_id = q.case_id AND s.node = source SEMI JOIN f t ON t.case_id = q.case_id AND t.node = target",
    "h13_types": tb.sql("r", "o") + "SELECT DISTINCT case_id, 'concept:' || cui source, 'type:' || entity_type target FROM o",
    "h19_evidence": tb.sql("r") + "SELECT case_id, relation, coalesce(head_cui, 'person') head, tail_cui tail, count(*) n, string_agg(DISTINCT concat_ws('-', head_start, head_end, tail_start, tail_end), ' ' ORDER BY concat_ws('-', head_start, head_end, tail_start, tail_end)) spans FROM r WHERE tail_cui IS NOT NULL AND (head_kind = 'Person' OR head_cui IS NOT NULL) GROUP BY ALL",
    "h15_best": KEYED_SQL + "SELECT case_id, head_start, tail_start, relation, score, rel_id FROM k",
    "h16_merged": KEYED_SQL + "SELECT * FROM v",
    "h17_compared": KEYED_SQL + f"SELECT relation, {CMP} FROM v GROUP BY relation UNION ALL SELECT 'TOTAL', {CMP} FROM v",
    "h18_degrees": GRAPH_SQL + ", z AS (SELECT case_id, count(DISTINCT node) vertices FROM (SELECT case_id, source node FROM q UNION ALL SELECT case_id, target FROM q) GROUP BY ALL) SELECT case_id, vertices, edges, round(2.0 * edges / vertices, 6)::double mean_degree FROM z JOIN (SELECT case_id, count(*) edges FROM q GROUP BY ALL) USING (case_id)",
    "a1_types": tb.sql("r", "o") + "SELECT entity_type, count(*) n, count(DISTINCT cui) n_cuis FROM o GROUP BY ALL",
    "a2_pivot": tb.sql("r") + "SELECT relation, " + ", ".join(f"count(*) FILTER (WHERE assertion_status = '{s}') {s}" for s in ["affirmed", "negated", "hedged", "historical", "family", "not_assessed"]) + " FROM r GROUP BY relation",
    "a3_case_sets": KEYED_SQL + "SELECT case_id, count(*) FILTER (WHERE origin = 'p1') only_p1, count(*) FILTER (WHERE origin = 'p2') only_p2, count(*) FILTER (WHERE origin = 'ambos') AS \"both\" FROM v GROUP BY case_id",
    "a8_shared_findings": NODES_SQL + "SELECT cui, count(*) cases, (count(*) * (count(*) - 1) // 2) pairs FROM n GROUP BY cui HAVING count(*) > 1",
    "a8_treatments": tb.sql("r") + "SELECT head_cui, tail_cui, count(DISTINCT case_id) n_cases, count(*) n FROM r WHERE head_entity_type = 'Diagnosis' AND tail_entity_type = 'Treatment' AND head_cui IS NOT NULL AND tail_cui IS NOT NULL GROUP BY ALL",
    "a8_demographics": tb.sql("c") + ", x AS (SELECT coalesce(gender, '?') gender, coalesce((floor(try_cast(age AS double) / 10) * 10)::int, -1) AS dec FROM c) SELECT gender, dec AS \"decade\", count(*) n, grouping(gender, dec)::int AS level FROM x GROUP BY CUBE (gender, dec)",
    "a8_vocabulary": tb.sql("r", "o", "g") + ", x AS (SELECT vocabulary, count(*) n FROM o JOIN (SELECT DISTINCT cui, vocabulary FROM g) USING (cui) GROUP BY ALL) SELECT vocabulary, n, round(n / sum(n) OVER (), 6) share FROM x",
}
QUERIES = {f.__name__: f for f in (o1_concepts, o2_edges, o3_first_edges, o4_pairs, o5_type_prior, h1_ids, h2_hashes, h4_concepts, h4_details, h4_occurrences, h5_mentions, h6_edges, h6_triggers, h6_warnings, h7_ontology_edges, h9_demographics, h10_faults, h11_filtered, h11_hidden, h12_fingerprints, h13_types, h15_best, h16_merged, h17_compared, h18_degrees, h19_evidence, a1_types, a2_pivot, a3_case_sets, a8_shared_findings, a8_treatments, a8_demographics, a8_vocabulary, a6_relations, a8_assertions, a8_text_and_ontology)}
