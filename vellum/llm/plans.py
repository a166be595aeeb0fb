"""Queries of the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import unpack
from ..operators.rank import earliest, earliest_text
from ..operators.references import reference_key
from ..session import cut, table
from . import cooccurrence, leakage, packing, repetition, sentences, splits


def pairs(spark: SparkSession, d: str, min_count: int) -> DataFrame:
    t = earliest(table(spark, d, "trechos"), "trecho_id", "recorded_at", "texto")
    return cooccurrence.surprise(cooccurrence.baskets(t, "trecho_id", cooccurrence.words("texto")), min_count)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that occur at least 5 times, more often than the null explains (5 % for a pair by itself), and then by the
    exact check 8 times as often as by frequencies alone. The level isn't corrected for the number of pairs, as the
    definition isn't; p1_significant has the pairs that stand after the correction."""
    often = (F.col("log10_p") <= math.log10(0.05)) & (F.col("n_ab") * F.col("n") >= 8 * F.col("n_a") * F.col("n_b"))
    return pairs(spark, d, 5).filter(often).select(F.col("a").alias("palavra_1"), F.col("b").alias("palavra_2"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its count, PMI, LLR, expectation under the null, p and q."""
    p = pairs(spark, d, 1)
    return p.select(F.col("a").alias("palavra_1"), F.col("b").alias("palavra_2"), F.col("n_ab").alias("contagem"), "pmi", "llr", "expected", "log10_p", "q_value")


def p1_significant(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of two or more trechos that occur together more often than the null explains, at a false-discovery rate of
    5 % over all pairs of the vocabulary."""
    p = pairs(spark, d, 2).filter("q_value <= 0.05 and n_ab > expected")
    return p.select(F.col("a").alias("palavra_1"), F.col("b").alias("palavra_2"), F.col("n_ab").alias("contagem"), "pmi", "expected", "log10_p", "q_value")


def p1_stale(spark: SparkSession, d: str) -> DataFrame:
    """The published pairs with their new count, 0 where a pair stands in no trecho any more."""
    return p1_compared(spark, d).filter("is_published").drop("is_published")


def published(spark: SparkSession, d: str) -> DataFrame:
    """The published counts, spelling and order made even; a pair published twice counts once, with its larger count."""
    old = table(spark, d, "tabela_pmi").select(F.lower(F.trim("palavra_1")).alias("x"), F.lower(F.trim("palavra_2")).alias("y"), F.col("contagem").alias("published"))
    return old.select(F.least("x", "y").alias("palavra_1"), F.greatest("x", "y").alias("palavra_2"), "published").groupBy("palavra_1", "palavra_2").agg(F.max("published").alias("published"))


def p1_compared(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that is published or found, with both counts: contagem is 0 where a published pair stands in no trecho any
    more, is_published tells a new pair from one published without a count."""
    t = earliest(table(spark, d, "trechos"), "trecho_id", "recorded_at", "texto")
    pairs = cooccurrence.pair_counts(cut(cooccurrence.baskets(t, "trecho_id", cooccurrence.words("texto"))))[0]
    new = pairs.select(F.col("a").alias("palavra_1"), F.col("b").alias("palavra_2"), F.col("n_ab").alias("contagem"))
    both = new.join(published(spark, d).withColumn("is_published", F.lit(True)), ["palavra_1", "palavra_2"], "full")
    return both.select("palavra_1", "palavra_2", F.coalesce("contagem", F.lit(0)).alias("contagem"), "published", F.coalesce("is_published", F.lit(False)).alias("is_published"))


P1_SQL = """
WITH w AS (SELECT DISTINCT trecho_id, unnest(regexp_extract_all(lower(texto), '\\p{L}+')) w FROM trechos WHERE trecho_id IS NOT NULL),
     n AS (SELECT count(DISTINCT trecho_id) n FROM w), f AS (SELECT w, count(*) n FROM w GROUP BY w),
     c AS (SELECT a.w a, b.w b, count(*) n_ab FROM w a JOIN w b USING (trecho_id) WHERE a.w < b.w GROUP BY ALL)
"""

def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every case text."""
    delivered = table(spark, d, "cases_clean")
    return sentences.sentences(earliest_text(delivered, "case_id", "loaded_at", "case_text"), "case_id", "case_text", corpus=delivered)


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document."""
    return sentences.sentences(table(spark, d, "documents"), "doc_id", "text")


NOBODY = ("ANONYMOUS", "ET AL")


def case_groups(spark: SparkSession, d: str) -> DataFrame:
    """Cases tied by article, by an author of their articles or by a source fragment."""
    cases = earliest(table(spark, d, "cases_clean"), "case_id", "loaded_at", "article_id", "source_case_ids")
    meta = unpack(table(spark, d, "metadata").select(reference_key("article_id").alias("a"), "authors"), ["a"], ["authors"]).withColumnRenamed("value", "w")
    who = F.upper(F.regexp_replace("w", r"\s+", " "))
    case, article = F.concat(F.lit("r:"), "case_id"), F.concat(F.lit("a:"), reference_key("article_id"))
    ties = [
        cases.select(case.alias("u"), article.alias("v")),
        cases.select(case.alias("u"), F.explode("source_case_ids").alias("s")).select("u", F.concat(F.lit("s:"), F.nullif(F.trim("s"), F.lit(""))).alias("v")),
        meta.select(F.concat(F.lit("a:"), "a").alias("u"), who.alias("w")).filter(~F.rtrim(F.col("w"), F.lit(".")).isin(*NOBODY)).select("u", F.concat(F.lit("w:"), "w").alias("v")),
    ]
    return splits.groups(cases.select("case_id"), ties)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return case_groups(spark, d).select(F.col("group").alias("group_case_id"), F.col("record").alias("case_id"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every case with its split, near 80/10/10."""
    return splits.assign(case_groups(spark, d), ["train", "validation", "test"], [0.8, 0.1, 0.1]).select(F.col("group").alias("group_case_id"), F.col("record").alias("case_id"), "split")


CAPACITY = 8192


def containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", packing.byte_tokens(F.col("text")), CAPACITY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that stand in more than one piece."""
    return containers(spark, d).filter("piece > 0").select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(containers(spark, d), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the items of which it holds a passage."""
    return leakage.search(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each item leaked into, 0 included."""
    n = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return table(spark, d, "eval_items").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_docs"))


#: What the query means by repetition: no cutoff under it is asked for.
LEAST_SHARE = 0.3


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents at or over the cutoff of their stratum: the least one, from a share of 30 % up, that is certified to reject
    few good documents."""
    measured, _ = repetition.judged(table(spark, d, "documents"), "doc_id", "text", [c for c in repetition.GRID if c >= LEAST_SHARE])
    return measured.filter("share >= cutoff").select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the share of its words that repeats, and whether it is over the cutoff of its stratum."""
    measured, _ = repetition.judged(table(spark, d, "documents"), "doc_id", "text")
    return measured.select("doc_id", "stratum", "words", "repeated", "share", (F.col("share") >= F.col("cutoff")).alias("rejected"))


def p8_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The certified cutoff of each stratum with its bound on false rejections."""
    return repetition.judged(table(spark, d, "documents"), "doc_id", "text")[1]



SQL = {
    "p1_found": P1_SQL + "SELECT a palavra_1, b palavra_2 FROM c JOIN f x ON x.w = a JOIN f y ON y.w = b, n WHERE n_ab >= 5 AND n_ab * n.n >= 8 * x.n * y.n",
    "p1_stale": P1_SQL + """, o AS (SELECT least(x, y) a, greatest(x, y) b, max(contagem) published FROM (SELECT lower(trim(palavra_1)) x, lower(trim(palavra_2)) y, contagem FROM tabela_pmi) GROUP BY ALL)
        SELECT o.a palavra_1, o.b palavra_2, coalesce(n_ab, 0) contagem, published FROM o LEFT JOIN c USING (a, b)""",
    "p1_compared": P1_SQL + """, o AS (SELECT least(x, y) a, greatest(x, y) b, max(contagem) published FROM (SELECT lower(trim(palavra_1)) x, lower(trim(palavra_2)) y, contagem FROM tabela_pmi) GROUP BY ALL)
        SELECT coalesce(c.a, o.a) palavra_1, coalesce(c.b, o.b) palavra_2, coalesce(n_ab, 0) contagem, published, o.a IS NOT NULL is_published FROM c FULL JOIN o ON c.a = o.a AND c.b = o.b""",
}
SQL |= {"p6_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 8192"}
QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_significant, p1_stale, p1_compared, p3_found, p3_documents, p5_found, p5_splits, p6_found, p6_containers, p6_fill, p7_found, p7_items, p8_found, p8_shares, p8_cutoffs)}
