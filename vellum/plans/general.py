"""Queries of the general data problems: packed fields (2) and orphan references (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed
from ..operators.rank import earliest
from ..operators.references import Edge, cascade, orphans, reference_key, validity
from ..session import table

LISTS = ["authors", "mesh_terms", "keywords", "major_mesh_terms"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    articles = earliest(table(spark, d, "metadata"), "article_id", "loaded_at", *LISTS)
    return packed.unpack(articles, ["article_id"], LISTS).select("article_id", "field_name", F.col("pos").cast("int").alias("pos"), "value")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Values and articles of each field."""
    return p2_found(spark, d).groupBy("field_name").agg(F.count("*").alias("n_values"), F.countDistinct("article_id").alias("n_articles"), F.max("pos").alias("longest"))


def direct_orphans(spark: SparkSession, d: str) -> DataFrame:
    concepts = validity(table(spark, d, "gazetteer"), "cui", "added_at", "retired_at")
    articles = validity(earliest(table(spark, d, "metadata"), "article_id", "loaded_at", "withdrawn_at"), "article_id", "loaded_at", "withdrawn_at")
    children = {
        "relations": (earliest(table(spark, d, "relations"), "rel_id", "extracted_at", "head_cui"), "rel_id", {"head_cui": concepts}, "extracted_at"),
        "umls_relations": (earliest(table(spark, d, "umls_relations"), "edge_id", "loaded_at", "head_cui", "tail_cui"), "edge_id", {"head_cui": concepts, "tail_cui": concepts}, "loaded_at"),
        "cases_clean": (earliest(table(spark, d, "cases_clean"), "case_id", "loaded_at", "article_id"), "case_id", {"article_id": articles}, "loaded_at"),
    }
    out = None
    for name, (rows, key, fields, at) in children.items():
        part = orphans(rows, key, fields, at).select(F.lit(name).alias("table_name"), "field_name", F.date_format("at", "yyyy-MM").alias("period"), F.col("row_key").cast("string").alias("row_key"), "reason")
        out = part if out is None else out.unionByName(part)
    return out


def cascaded(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_key, field_name, period, reason, depth): every orphaned row, direct (depth 0) or inherited, by the
    fixpoint down the foreign keys whose parents refer to something themselves: those of cases. Concepts and articles don't,
    so what refers to them is direct or sound. Each row has its own month; the field of an inherited row is the key that
    leads up to its orphaned parent, its reason is 'inherited'."""
    child = lambda name, key, at: earliest(table(spark, d, name), key, at, "case_id").select(F.col(key).alias("key"), F.trim("case_id").alias("ref"), F.lit("case_id").alias("field_name"), F.date_format(at, "yyyy-MM").alias("period"), F.lit("inherited").alias("reason"))
    edges = [Edge("relations", "cases_clean", child("relations", "rel_id", "extracted_at")), Edge("trechos", "cases_clean", child("trechos", "trecho_id", "recorded_at"))]
    return cascade(direct_orphans(spark, d), edges, keep=["field_name", "period", "reason"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The references that are orphans themselves: depth 0 of the cascade."""
    return cascaded(spark, d).filter("depth = 0").select("table_name", "field_name", "period", "row_key")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphan references by table, field, month and reason."""
    return cascaded(spark, d).groupBy("table_name", "field_name", "period", "reason").agg(F.count("*").alias("n"))


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are orphans of each table, by distance from the nearest direct orphan."""
    return cascaded(spark, d).select("table_name", "row_key", "depth").distinct().groupBy("table_name", "depth").agg(F.count("*").alias("n_rows"))


def p4_inherited(spark: SparkSession, d: str) -> DataFrame:
    """Every orphaned row, direct (depth 0) or inherited, with its table, its own month and its distance."""
    return cascaded(spark, d).select("table_name", "period", "row_key", "depth").distinct()


ORPHANS_SQL = """
WITH art AS (SELECT upper(trim(article_id)) k, arg_min(loaded_at, loaded_at) s, min_by(withdrawn_at_s, loaded_at) w FROM (
        SELECT *, coalesce(withdrawn_at, TIMESTAMP '9999-12-31') withdrawn_at_s FROM metadata) GROUP BY article_id),
     rel AS (SELECT rel_id, min_by(coalesce(head_cui, ''), extracted_at) head_cui, min_by(coalesce(case_id, ''), extracted_at) case_id, min(extracted_at) t FROM relations GROUP BY rel_id),
     uml AS (SELECT edge_id, min_by(coalesce(head_cui, ''), loaded_at) head_cui, min_by(coalesce(tail_cui, ''), loaded_at) tail_cui, min(loaded_at) t FROM umls_relations GROUP BY edge_id),
     cas AS (SELECT case_id, min_by(coalesce(article_id, ''), loaded_at) article_id, min(loaded_at) t FROM cases_clean GROUP BY case_id),
     refs AS (SELECT 'relations' table_name, 'head_cui' field_name, rel_id::varchar row_key, upper(trim(head_cui)) k, t FROM rel
        UNION ALL SELECT 'umls_relations', 'head_cui', edge_id::varchar, upper(trim(head_cui)), t FROM uml
        UNION ALL SELECT 'umls_relations', 'tail_cui', edge_id::varchar, upper(trim(tail_cui)), t FROM uml
        UNION ALL SELECT 'cases_clean', 'article_id', case_id, upper(trim(article_id)), t FROM cas),
     parents AS (SELECT 'c' kind, upper(trim(cui)) k, added_at s, coalesce(retired_at, TIMESTAMP '9999-12-31') e FROM gazetteer
        UNION ALL SELECT 'a', k, s, w FROM art),
     direct AS (SELECT table_name, field_name, strftime(t, '%Y-%m') period, row_key,
            CASE WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.k = r.k AND (p.kind = 'a') = (field_name = 'article_id') AND e > s) THEN 'absent'
                 WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.k = r.k AND (p.kind = 'a') = (field_name = 'article_id') AND e > s AND s <= t) THEN 'not yet'
                 ELSE 'taken back' END reason
        FROM refs r WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.k = r.k AND (p.kind = 'a') = (field_name = 'article_id') AND s <= t AND e > t))
"""
CASCADE_SQL = ORPHANS_SQL + """, tre AS (SELECT trecho_id, min_by(coalesce(case_id, ''), recorded_at) case_id, min(recorded_at) t FROM trechos GROUP BY trecho_id),
    kids AS (SELECT 'relations' table_name, strftime(t, '%Y-%m') period, rel_id::varchar row_key, trim(case_id) ref FROM rel
        UNION ALL SELECT 'trechos', strftime(t, '%Y-%m'), trecho_id::varchar, trim(case_id) FROM tre),
    heirs AS (SELECT table_name, 'case_id' field_name, period, row_key, 'inherited' reason FROM kids k WHERE ref IN (SELECT row_key FROM direct WHERE table_name = 'cases_clean')
        AND NOT EXISTS (SELECT 1 FROM direct t WHERE t.table_name = k.table_name AND t.row_key = k.row_key)),
    every AS (SELECT *, 0 depth FROM direct UNION ALL SELECT *, 1 FROM heirs)
"""
SQL = {
    "p4_found": ORPHANS_SQL + "SELECT table_name, field_name, period, row_key FROM direct",
    "p4_report": CASCADE_SQL + "SELECT table_name, field_name, period, reason, count(*) n FROM every GROUP BY ALL",
    "p4_cascade": CASCADE_SQL + "SELECT table_name, depth, count(DISTINCT row_key) n_rows FROM every GROUP BY ALL",
    "p4_inherited": CASCADE_SQL + "SELECT DISTINCT table_name, period, row_key, depth FROM every",
}
QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p4_found, p4_report, p4_cascade, p4_inherited)}
