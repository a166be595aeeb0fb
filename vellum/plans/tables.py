"""The delivered tables with one row a key, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import earliest, earliest_text
from ..operators.references import reference_key
from ..session import table

TYPES = {
    "Symptom": ("TX01", "TX02", "TX03"), "Finding": ("TX04", "TX05", "TX06"), "Diagnosis": ("TX07", "TX08", "TX09"),
    "Treatment": ("TX10", "TX11", "TX12"), "Exam": ("TX13", "TX14", "TX15"), "BodyPart": ("TX16", "TX17", "TX18"),
}
VOCABULARIES = {"MEDLEX": 0, "CLINVOC": 1, "DXLIST": 2, "DRUGIX": 3, "LABCODE": 4}


CASE = "article_id age gender age_upstream gender_upstream age_method gender_method case_text source_case_ids".split()


def cases(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """Cases; only the asked columns are read. Texts of keys that aren't repeated are shuffled by no one."""
    first = earliest_text if columns is None or "case_text" in columns else earliest
    return first(table(spark, d, "cases_clean"), "case_id", "loaded_at", *(columns or CASE))


RELATION = "case_id article_id relation assertion_status head_kind head_start head_end head_cui head_entity_type head_text tail_start tail_end tail_cui tail_entity_type tail_text trigger_text trigger_start trigger_end trigger_category sent_start sent_end token_gap same_clause score rule_path".split()


def relations(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """Relations with concept ids in one spelling; only the asked columns are read."""
    cols = columns or RELATION
    r = earliest(table(spark, d, "relations"), "rel_id", "extracted_at", *cols)
    return r.withColumns({c: reference_key(c) for c in ("head_cui", "tail_cui") if c in cols})


def articles(spark: SparkSession, d: str) -> DataFrame:
    return earliest(table(spark, d, "metadata"), "article_id", "loaded_at", "journal", "year", "license")


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return earliest(table(spark, d, "trechos"), "trecho_id", "recorded_at", "case_id", "texto")


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gazetteer").select("term_norm", "sort_key", reference_key("cui").alias("cui"), "tui", "term_pref", "vocabulary", "tty", "n_tokens", "priority", "is_stopterm", "added_at", "retired_at").distinct()


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, e) for e, ts in TYPES.items() for t in ts], "tui string, entity_type string")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Concept mentions of the delivered relations: heads and tails, one row a span."""
    r = relations(spark, d, ["case_id", "head_cui", "head_entity_type", "head_start", "head_end", "head_text", "tail_cui", "tail_entity_type", "tail_start", "tail_end", "tail_text"])
    end = lambda x: F.struct(F.col(f"{x}_cui").alias("cui"), F.col(f"{x}_entity_type").alias("entity_type"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end"), F.col(f"{x}_text").alias("surface"))
    return r.select("case_id", F.explode(F.array(end("head"), end("tail"))).alias("m")).select("case_id", "m.*").filter("start >= 0 and cui is not null").distinct()


def sql(*names: str) -> str:
    """WITH clause of the named tables."""
    one = "{0} AS (SELECT * FROM {1} QUALIFY row_number() OVER (PARTITION BY {2} ORDER BY {3} NULLS LAST) = 1)"
    clauses = {
        "c": one.format("c", "cases_clean", "case_id", "loaded_at"),
        "m": one.format("m", "metadata", "article_id", "loaded_at"),
        "t": one.format("t", "trechos", "trecho_id", "recorded_at"),
        "r": "r AS (SELECT * REPLACE (nullif(upper(trim(head_cui)), '') AS head_cui, nullif(upper(trim(tail_cui)), '') AS tail_cui) FROM relations QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY extracted_at) = 1)",
        "g": "g AS (SELECT DISTINCT term_norm, sort_key, nullif(upper(trim(cui)), '') cui, tui, term_pref, vocabulary, tty, n_tokens, priority, is_stopterm, added_at, retired_at FROM gazetteer)",
        "e": one.format("e0", "umls_relations", "edge_id", "loaded_at") + ", e AS (SELECT * REPLACE (nullif(upper(trim(head_cui)), '') AS head_cui, nullif(upper(trim(tail_cui)), '') AS tail_cui) FROM e0)",
        "o": """o AS (SELECT DISTINCT case_id, cui, entity_type, start, "end", surface FROM (
            SELECT case_id, head_cui cui, head_entity_type entity_type, head_start start, head_end "end", head_text surface FROM r
            UNION ALL SELECT case_id, tail_cui, tail_entity_type, tail_start, tail_end, tail_text FROM r) WHERE start >= 0 AND cui IS NOT NULL)""",
    }
    return "WITH " + ", ".join(clauses[n] for n in names) + " "
