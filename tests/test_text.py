"""Text functions on hand-made inputs."""

from pyspark.sql import functions as F

from vellum.functions import text as ft
from vellum.operators import corpus


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_normalize(spark):
    assert one(spark, "  Oedema\tof the  COELIAC‑axis, raised ", ft.normalize) == "edema of the celiac-axis, raized"
    assert one(spark, None, ft.normalize) is None
    assert one(spark, "pancreatitis, acute", ft.sort_key) == one(spark, "acute pancreatitis", ft.sort_key) == "acute pancreatitis"


def test_words_and_ngrams(spark):
    assert one(spark, "COVID-19 and SARS-CoV-2, 5-year", ft.words) == ["covid-19", "and", "sars-cov-2", "5", "year"]
    a = spark.createDataFrame([(["a", "b", "a", "b"],)], "t array<string>").select(ft.ngrams("t", 2).alias("r"), ft.ngrams("t", 5).alias("e")).first()
    assert a["r"] == ["a b", "b a", "a b"] and a["e"] == []


def test_number_words(spark):
    assert len(ft.number_words()) == 100
    assert one(spark, "Twenty-six-year-old, one of forty", lambda c: ft.digits_for_words(c)) == "26-year-old, 1 of 40"
    assert one(spark, "someone " + "x" * 700 + " two", ft.digits_for_words).endswith(" two")


def test_percent_encode(spark):
    assert one(spark, "a b*c~d/é", ft.percent_encode) == "a%20b%2Ac~d%2F%C3%A9"


AGES = [
    ("A 39-week-old newborn girl presented with fever.", "0", "newborn-keyword", "Female"),
    ("A 44-year-old man presented.", "44", "opening-year-old", "Male"),
    ("Seven-month-old infant was seen. She cried.", "0.58", "opening-month-old", "Female"),
    ("Patients 45-50 years old were seen.", "", "range-detected", "Unknown"),
    ("A baby boy was born.", "0", "baby-keyword", "Male"),
    ("This case report complies with rules. Informed consent was obtained from all. A 2.5-year-old boy came.", "2.5", "opening-year-old", "Male"),
    ("x" * 100 + " a woman aged 61 came.", "61", "fallback-anywhere", "Female"),
    ("xyzzy", "", "not-found", "Unknown"),
    ("", "", "not-found", "Unknown"),
    (None, "", "not-found", "Unknown"),
]


def test_demographics(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(AGES)], "i int, case_text string")
    got = [(r["found_age"], r["found_age_method"], r["found_gender"]) for r in corpus.demographics(df).orderBy("i").collect()]
    assert got == [tuple(a[1:]) for a in AGES]


def test_merge_fragments(spark):
    c = spark.createDataFrame([("a_2", "two", "", "Unknown"), ("a_1", "one", None, "Female"), ("b", "x", "3", None)], "case_id string, case_text string, age string, gender string")
    g = spark.createDataFrame([("a", "a_1", 1), ("a", "a_2", 2), ("b", "b", 1), ("none", "gone", 1)], "group_id string, case_id string, pos int")
    got = {r["group_id"]: r for r in corpus.merge_fragments(c, g).collect()}
    assert got["a"]["case_text"] == "one\n\ntwo" and got["a"]["gender"] == "Female" and got["a"]["source_case_ids"] == ["a_1", "a_2"]
    assert got["b"]["age"] == "3" and got["b"]["gender"] == "Unknown" and set(got) == {"a", "b"}


def test_span_faults(spark):
    cases = spark.createDataFrame([("c", "Lípase 850")], "case_id string, case_text string")
    s = spark.createDataFrame([("c", 0, 6, "Lípase"), ("c", 0, 6, "Lipase"), ("z", 0, 1, "L"), ("c", -1, -1, "")], "case_id string, s int, e int, x string")
    assert sorted(r["fault"] for r in corpus.span_faults(s, cases, "s", "e", "x").collect()) == ["foreign", "text"]
