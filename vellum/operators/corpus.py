"""Corpus cleaning: drops, merged fragments, demographics from text, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits_for_words

OPENING, FALLBACK, GENDER_WINDOW, PRONOUN_WINDOW = 70, 700, 350, 1000
NUMBER = r"[0-9]{1,3}(?:\.[0-9]+)?"
#: Fixed value: statements of consent and ethics.
BOILERPLATE = r"(?:this (?:case )?report complies with[^.]*\.\s*)|(?:informed (?:written )?consent (?:was|has been) obtained[^.]*\.\s*)|(?:(?:institutional review board|ethics committee|irb) approval[^.]*\.\s*)"
YEARS = rf"({NUMBER})[-\s]years?[-\s]old|({NUMBER})\s+years?\s+of\s+age|\baged\s+({NUMBER})\b"
PART_YEARS = rf"({NUMBER})[-\s](day|week|month)s?[-\s]old|({NUMBER})\s+(day|week|month)s?\s+of\s+age"
AGE_RANGE = rf"{NUMBER}\s*(?:-|to)\s*{NUMBER}\s+years?\s+old"


def without_boilerplate(c: Column) -> Column:
    """The text without the first two consent or ethics statements: one replacement of the first match, twice."""
    once = lambda x: F.regexp_replace(x, rf"(?is)\A(.*?)(?:{BOILERPLATE})(.*)\z", "$1$2")
    has = F.lower(c).rlike("complies with|obtained|approval")
    return F.when(has, once(once(c))).otherwise(c)


def merge_fragments(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each group of fragments (groups: group_id, case_id, pos): texts joined by a blank line in the order of pos,
    the first non-blank age, the first known gender (else Unknown), the fragments' ids. Fragments without a case are
    skipped; ties of pos go by case_id."""
    f = cases.join(groups, "case_id")
    at = F.struct("pos", "case_id")
    first = lambda c, bad: F.min(F.when(~F.lower(F.trim(c)).isin(*bad) & F.col(c).isNotNull(), F.struct("pos", "case_id", F.col(c).alias("v"))))["v"]
    return f.groupBy("group_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "case_id", "case_text"))), lambda x: x["case_text"]), "\n\n").alias("case_text"),
        first("age", [""]).alias("age"),
        F.coalesce(first("gender", ["", "unknown"]), F.lit("Unknown")).alias("gender"),
        F.transform(F.array_sort(F.collect_list(at)), lambda x: x["case_id"]).alias("source_case_ids"),
    )


def demographics(cases: DataFrame, text: str = "case_text") -> DataFrame:
    """cases with found_age, found_age_method, found_gender, found_gender_method: the first rule of a cascade that applies.

    Ages: newborn words, an age range (which gives no age), years at the opening, days, weeks or months at the opening (as
    parts of a year, rounded to 2 places), a baby, years within a wider window. Genders: the first gender word, else the
    majority of pronouns. Null texts give no age and an unknown gender.
    """
    d = cases.withColumn("__plain", without_boilerplate(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumn("__digits", F.substring(digits_for_words(F.col("__plain"), FALLBACK), 1, FALLBACK)).withColumn("__open", F.substring("__digits", 1, OPENING))
    years = lambda c: F.coalesce(*[F.nullif(F.regexp_extract(c, f"(?i){YEARS}", k), F.lit("")) for k in (1, 2, 3)])
    part = lambda a, b: F.coalesce(F.nullif(F.regexp_extract("__open", f"(?i){PART_YEARS}", a), F.lit("")), F.nullif(F.regexp_extract("__open", f"(?i){PART_YEARS}", b), F.lit("")))
    d = d.withColumns({"__years": years("__open"), "__wide": years("__digits"), "__n": part(1, 3).cast("double"), "__unit": F.lower(part(2, 4))})
    days = F.when(F.col("__unit") == "day", 1.0).when(F.col("__unit") == "week", 7.0).otherwise(30.44)
    plain = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    rules = [
        (F.col("__open").rlike(r"(?i)\bnewborns?\b|\bneonat"), F.lit("0"), F.lit("newborn-keyword")),
        (F.col("__open").rlike(f"(?i){AGE_RANGE}"), F.lit(""), F.lit("range-detected")),
        (F.col("__years").isNotNull(), plain(F.col("__years").cast("double")), F.lit("opening-year-old")),
        (F.col("__n").isNotNull(), F.bround(F.col("__n") * days / 365.25, 2).cast("string"), F.concat(F.lit("opening-"), F.col("__unit"), F.lit("-old"))),
        (F.col("__open").rlike(r"(?i)\bbaby\s+(?:boy|girl)\b"), F.lit("0"), F.lit("baby-keyword")),
        (F.col("__wide").isNotNull(), plain(F.col("__wide").cast("double")), F.lit("fallback-anywhere")),
    ]
    age, method = F.lit(""), F.lit("not-found")
    for test, value, name in reversed(rules):
        age, method = F.when(test, value).otherwise(age), F.when(test, name).otherwise(method)
    d = d.withColumns({"found_age": age, "found_age_method": method})
    d = d.withColumn("__word", F.lower(F.regexp_extract(F.substring("__plain", 1, GENDER_WINDOW), r"(?i)\b(boy|girl|male|female|man|woman)\b", 1)))
    window = F.substring("__plain", 1, PRONOUN_WINDOW)
    d = d.withColumns({"__she": F.regexp_count(window, F.lit(r"(?i)\b(?:she|her)\b")), "__he": F.regexp_count(window, F.lit(r"(?i)\b(?:he|his|him)\b"))})
    word = F.col("__word") != ""
    male = F.col("__word").isin("boy", "male", "man")
    gender = F.when(word & male, "Male").when(word, "Female").when(F.col("__she") > F.col("__he"), "Female").when(F.col("__he") > F.col("__she"), "Male").otherwise("Unknown")
    how = F.when(word, "opening-word").when(F.col("__she") != F.col("__he"), "pronoun-majority").otherwise("not-found")
    return d.withColumns({"found_gender": gender, "found_gender_method": how}).drop("__plain", "__digits", "__open", "__years", "__wide", "__n", "__unit", "__word", "__she", "__he")


def override(cases: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """cases with the non-null columns of overrides (key and any of the case columns) put in their place."""
    cols = [c for c in overrides.columns if c != key]
    o = overrides.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in cols])
    return cases.join(o, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in cols}).drop(*[f"__{c}" for c in cols])


def span_faults(spans: DataFrame, cases: DataFrame, start: str, end: str, surface: str) -> DataFrame:
    """spans with a fault column: 'foreign' (no such case) or 'text' (the text at the offsets isn't the surface), faulty rows
    only. Offsets are half-open code points; rows with a null or negative offset are no spans."""
    s = spans.filter(F.col(start) >= 0).join(cases.select("case_id", F.col("case_text").alias("__text")), "case_id", "left")
    wrong = F.expr(f"substring(__text, {start} + 1, {end} - {start})") != F.col(surface)
    return s.withColumn("fault", F.when(F.col("__text").isNull(), "foreign").when(wrong, "text")).filter("fault is not null").drop("__text")
