"""Queries of n-gram statistics, the language model, features, weights and evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import association, evaluate, features, lexicon, relate
from ..session import cut
from . import tables as tb
from .corpus import WORD_SQL, rule_inputs, snippet_words
from .graphs import KEY, KEYED_SQL, keyed

FUNCTION_WORDS = "de do da em no na a o e um uma com por para of the to in and with by for on at".split()


def n2_association(spark: SparkSession, d: str) -> DataFrame:
    """PMI and LLR of the pairs of adjacent words that occur at least 5 times."""
    a = association.association(snippet_words(spark, d), "w", 5).filter("c >= 5")
    return a.select("w1", "w2", "c", F.round("pmi", 6).alias("pmi"), F.round("llr", 4).alias("llr"))


def n4_top_pmi(spark: SparkSession, d: str) -> DataFrame:
    """The 40 pairs of highest PMI."""
    return n2_association(spark, d).select("w1", "w2", "c", "pmi").orderBy(F.desc("pmi"), "w1", "w2").limit(40)


def n5_table(spark: SparkSession, d: str) -> DataFrame:
    """Two-word grams between entities and in whole texts, side by side."""
    between = association.counts(snippet_words(spark, d), "w", 2).select("gram", F.col("count").alias("between"))
    whole = association.counts(tb.cases(spark, d, ["case_text"]).select(ft.words("case_text").alias("w")), "w", 2).select("gram", F.col("count").alias("corpus"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return between.join(whole, "gram", "full").select("gram", z("between"), z("corpus")).filter("between + corpus >= 2")


def n7_log_probability(spark: SparkSession, d: str) -> DataFrame:
    w = snippet_words(spark, d)
    return association.log_probability(w, w, "w", "trecho_id").withColumn("logp", F.round("logp", 6))


def n9_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Log probability of each snippet under a model without the snippets of its case."""
    w = snippet_words(spark, d).filter("case_id is not null")
    return association.held_out(w, "w", "trecho_id", "case_id").withColumn("logp", F.round("logp", 6))


#: Words of the trigger lexicon.
LEXICON = sorted({w for ws in relate.TRIGGERS.values() for w in ws.split()})


def n10_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that may be triggers: 3 or more times, not both function words, with both measures and whether one of the words
    is in the lexicon."""
    a = association.association(snippet_words(spark, d), "w", 3).filter("c >= 3")
    f = lambda c: F.col(c).isin(FUNCTION_WORDS)
    listed = F.col("w1").isin(LEXICON) | F.col("w2").isin(LEXICON)
    return a.filter(~(f("w1") & f("w2")) & ~f("w1")).select("w1", "w2", "c", F.round("pmi", 6).alias("pmi"), F.round("llr", 4).alias("llr"), listed.alias("in_lexicon"))


def a4_between(spark: SparkSession, d: str) -> DataFrame:
    """The 40 most frequent phrases between entities, with the lexicon flag."""
    return n10_triggers(spark, d).select("w1", "w2", "c", "in_lexicon").orderBy(F.desc("c"), "w1", "w2").limit(40)


def a7_gold(spark: SparkSession, d: str) -> DataFrame:
    """How many judged pairs there are of each relation, and how many of them hold."""
    return gold(spark, d).groupBy("gold_relation").agg(F.count("*").alias("n"), F.count_if("is_relation").alias("held"))


def a7_hapax(spark: SparkSession, d: str) -> DataFrame:
    """Share of the two-word grams that occur once."""
    g = association.counts(snippet_words(spark, d), "w", 2)
    return g.agg(F.count("*").alias("grams"), F.count_if(F.col("count") == 1).alias("hapax")).withColumn("share", F.round(F.col("hapax") / F.col("grams"), 6))


CANDIDATE = "case_id head_kind head_start head_end head_entity_type tail_start tail_end tail_entity_type sent_start token_gap same_clause rule_path".split()


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Delivered relations with the text between their ends."""
    r = tb.relations(spark, d, CANDIDATE).join(tb.cases(spark, d, ["case_text"]).select("case_id", "case_text"), "case_id")
    z = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return r.withColumn("between", features.text_between(F.col("case_text"), z("head_end"), z("tail_start"), z("head_start"), z("tail_end"), z("sent_start")))


def f1_between(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("rel_id", "between")


def f2_structural(spark: SparkSession, d: str) -> DataFrame:
    return features.structural(candidates(spark, d))


def f3_association(spark: SparkSession, d: str) -> DataFrame:
    """Highest and mean PMI and highest LLR of the word pairs of each snippet, scaled."""
    w = snippet_words(spark, d)
    a = association.association(w, "w", 5)
    p = association.bigrams(w, "w", ["trecho_id"]).drop("c").join(a, ["w1", "w2"])
    return p.groupBy("trecho_id").agg(F.round(F.max("pmi") / 12, 6).alias("pmi_max"), F.round(F.avg("pmi") / 12, 6).alias("pmi_mean"), F.round(F.least(F.max("llr") / 300, F.lit(1.0)), 6).alias("llr_max"))


def f4_ngram_features(spark: SparkSession, d: str) -> DataFrame:
    """Two-word grams of each candidate's text between, those seen in two or more candidates."""
    g = candidates(spark, d).select("rel_id", F.explode(F.array_distinct(ft.ngrams(ft.words("between"), 2))).alias("gram"))
    return g.join(g.groupBy("gram").agg(F.count("*").alias("n")).filter("n >= 2").select("gram"), "gram", "left_semi").select("rel_id", "gram")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Judged pairs made of the delivered relations: one a pair, a relation if its rules saw one clause, with the type of the
    best-scored relation of the pair."""
    r = tb.relations(spark, d, ["case_id", "head_start", "tail_start", "relation", "score", "rule_path", "assertion_status"]).filter("assertion_status <> 'not_assessed'")
    best = lexicon.best(r, ["case_id", "head_start", "tail_start"], ["-score", "rel_id"])
    return best.select("case_id", "head_start", "tail_start", F.array_contains("rule_path", "clause").alias("is_relation"), F.col("relation").alias("gold_relation"))


PAIR = ["case_id", "head_start", "tail_start"]


def predicted(spark: SparkSession, d: str, least: float) -> DataFrame:
    """The best relation of each pair over a score, typed by its trigger where it has one."""
    r = tb.relations(spark, d, ["case_id", "head_start", "tail_start", "relation", "score", "trigger_category"]).filter(F.col("score") >= least)
    best = lexicon.best(r, PAIR, ["-score", "rel_id"])
    return best.select(*PAIR, F.when(F.col("trigger_category") == "LOCATE", "LOCATED_IN").otherwise(F.col("relation")).alias("relation"), "score")


def judged(spark: SparkSession, d: str, least: float = 1.0) -> DataFrame:
    return evaluate.judged(gold(spark, d), predicted(spark, d, least), PAIR)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def f5_gold(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d)


def f6_weak_labels(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).select(*KEY, F.when(F.col("score") >= 1.0, F.col("relation")).otherwise("NENHUMA").alias("label"))


#: Groups of features beside the structural ones, by variant.
VARIANTS = {"estrutura": [], "lexico": ["ngram"], "pmi": ["pmi"], "lm": ["lm"], "completo": ["ngram", "pmi", "lm"]}


def feature_groups(spark: SparkSession, d: str) -> DataFrame:
    """(id, case_id, feature, value, group, label): every feature of the candidates: structural, word pairs between the ends
    that two or more candidates have, association of these pairs, and the held-out language score. The label is the relation
    if its rules saw one clause, else NENHUMA. Written once, as all variants read it."""
    c = cut(candidates(spark, d).join(tb.relations(spark, d, ["relation"]).select("rel_id", "relation"), "rel_id"))
    one = lambda df, name: df.select("rel_id", "feature", F.col("value").cast("double").alias("value"), F.lit(name).alias("group"))
    grams = c.select("rel_id", F.explode(F.array_distinct(ft.ngrams(ft.words("between"), 2))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n >= 2").select("gram")
    ngram = grams.join(often, "gram", "left_semi").select("rel_id", F.concat(F.lit("ngrama:"), "gram").alias("feature"), F.lit(1.0).alias("value"))
    words = c.select("rel_id", ft.words("between").alias("w"))
    pairs = association.bigrams(words, "w", ["rel_id"]).drop("c").join(association.association(snippet_words(spark, d), "w", 5), ["w1", "w2"]).groupBy("rel_id").agg((F.max("pmi") / 12).alias("pmi_max"), (F.avg("pmi") / 12).alias("pmi_media"), F.least(F.max("llr") / 300, F.lit(1.0)).alias("llr_max"))
    pmi = pairs.select("rel_id", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in ("pmi_max", "pmi_media", "llr_max")])).alias("f")).select("rel_id", "f.*")
    lm = lm_scores(c).select("rel_id", F.lit("lm_score").alias("feature"), F.col("lm_score").alias("value"))
    every = one(features.structural(c), "estrutura").unionByName(one(ngram, "ngram")).unionByName(one(pmi, "pmi")).unionByName(one(lm, "lm"))
    label = F.when(F.array_contains("rule_path", "clause"), F.col("relation")).otherwise("NENHUMA")
    return cut(every.join(c.select("rel_id", "case_id", label.alias("label")), "rel_id").withColumnRenamed("rel_id", "id"))


def of_variant(f: DataFrame, variant: str) -> DataFrame:
    return f.filter(F.col("group").isin("estrutura", *VARIANTS[variant]))


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """(id, case_id, label, x): what feature_groups() has, as an array of (feature, value) a candidate, but with the word pairs
    that one candidate has alone: variant() leaves those out, when they are counted."""
    c = cut(candidates(spark, d).join(tb.relations(spark, d, ["relation"]).select("rel_id", "relation"), "rel_id"))
    words = c.select("rel_id", ft.words("between").alias("w"))
    pairs = association.bigrams(words, "w", ["rel_id"]).drop("c").join(association.association(snippet_words(spark, d), "w", 5), ["w1", "w2"]).groupBy("rel_id").agg((F.max("pmi") / 12).alias("pmi_max"), (F.avg("pmi") / 12).alias("pmi_media"), F.least(F.max("llr") / 300, F.lit(1.0)).alias("llr_max"))
    j = c.join(pairs, "rel_id", "left").join(lm_scores(c), "rel_id", "left")
    pair = lambda name, value: F.struct(name.alias("feature"), value.cast("double").alias("value"))
    grams = F.coalesce(F.array_distinct(ft.ngrams(ft.words("between"), 2)), F.array().cast("array<string>"))
    few = F.filter(F.array(*[pair(F.lit(n), F.col(n)) for n in ("pmi_max", "pmi_media", "llr_max", "lm_score")]), lambda x: x["value"].isNotNull())
    x = F.concat(features.structure(), F.transform(grams, lambda g: pair(F.concat(F.lit("ngrama:"), g), F.lit(1.0))), few)
    label = F.when(F.array_contains("rule_path", "clause"), F.col("relation")).otherwise("NENHUMA")
    return j.select(F.col("rel_id").alias("id"), "case_id", label.alias("label"), x.alias("x"))


def packed(rows: DataFrame, folds: int = 1) -> features.Packed:
    """The examples of feature_rows, written once; with folds by hash of the case."""
    fold = F.pmod(F.xxhash64("case_id"), F.lit(folds)) if folds > 1 else F.lit(-1)
    return features.packed(rows.withColumn("fold", fold))


def group(feature: str) -> str:
    """The group of features that a name is of."""
    return "ngram" if feature.startswith("ngrama:") else "lm" if feature == "lm_score" else "pmi" if feature in ("pmi_max", "pmi_media", "llr_max") else "estrutura"


def variant(examples: features.Packed, name: str) -> features.Packed:
    """The features of a variant: of the word pairs those that two or more candidates have."""
    return examples.only(lambda f, n: (g := group(f)) == "estrutura" or g in VARIANTS[name] and (g != "ngram" or n >= 2))


def f7_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of relation against none on all groups of features."""
    f = feature_rows(spark, d).withColumn("label", F.when(F.col("label") == "NENHUMA", "NENHUMA").otherwise("REL"))
    return features.one_vs_rest(variant(packed(f), "completo")).filter("class = 'REL'").select("feature", "weight")


def f9_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of each relation against the rest on all groups of features."""
    return features.one_vs_rest(variant(packed(feature_rows(spark, d)), "completo")).select("class", "feature", "weight")


def f11_variants(spark: SparkSession, d: str) -> DataFrame:
    """For each variant of features, the classes that its models give to the candidates, against the labels."""
    f, out = packed(feature_rows(spark, d)), None
    for v in VARIANTS:
        got = features.classified(variant(f, v))
        n = got.groupBy("label").agg(F.count_if(F.col("class") == F.col("label")).alias("agree"), F.count("*").alias("n")).withColumn("variant", F.lit(v))
        out = n if out is None else out.unionByName(n)
    return out


def f12_cross_checked(spark: SparkSession, d: str) -> DataFrame:
    """How far another fitter, the engine's own multinomial regression, gives the candidates the same class as one against the
    rest, on structural features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    f = of_variant(feature_groups(spark, d), "estrutura")
    own = features.applied(f, features.one_vs_rest(f)).select("id", F.col("class").alias("own"))
    rows = f.groupBy("id", "label").agg(F.collect_list("feature").alias("names"))
    coded = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    x = CountVectorizer(inputCol="names", outputCol="x", binary=True).fit(rows).transform(coded.transform(rows))
    got = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-4, maxIter=100).fit(x).transform(x)
    name = F.element_at(F.array(*map(F.lit, coded.labels)), F.col("prediction").cast("int") + 1)
    return got.select("id", "label", name.alias("other")).join(own, "id").groupBy("label").agg(F.count_if(F.col("own") == F.col("other")).alias("same"), F.count("*").alias("n"))


def f9_decided(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the candidates under fixed weights."""
    w = spark.createDataFrame([("REL", "mesma_clausula", 1.2), ("REL", "distancia:1_3", 1.0), ("REL", "distancia:mais_10", -1.5), ("NENHUMA", "n_palavras_entre", 2.0), ("NENHUMA", "paciente_cabeca", 0.5)], "class string, feature string, weight double")
    b = spark.createDataFrame([("REL", -0.5), ("NENHUMA", 0.1)], "class string, bias double")
    z = features.scores(features.structural(candidates(spark, d)), w, b)
    return features.decided(z).withColumn("probability", F.round("probability", 6))


def f13_top_weights(spark: SparkSession, d: str) -> DataFrame:
    """The 15 weights of largest size."""
    return f7_weights(spark, d).orderBy(F.desc(F.abs("weight")), "feature").limit(15)


def v1_detection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.detection(judged(spark, d), []))


def v2_per_relation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.per_relation(judged(spark, d)))


def v2_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Of the judged relations that a strict threshold finds, how many have the assertion that the best candidate of their pair
    is judged to have."""
    r = tb.relations(spark, d, ["case_id", "head_start", "tail_start", "score", "rule_path", "assertion_status"])
    g = lexicon.best(r.filter("assertion_status <> 'not_assessed'"), PAIR, ["-score", "rel_id"]).select(*PAIR, F.array_contains("rule_path", "clause").alias("is_relation"), F.col("assertion_status").alias("gold_assertion"))
    p = lexicon.best(r.filter("score >= 1.0"), PAIR, ["-score", "rel_id"]).select(*PAIR, F.col("assertion_status").alias("assertion"))
    return evaluate.assertions(g, p, PAIR).withColumn("accuracy", F.round("accuracy", 6))


def v4_ablations(spark: SparkSession, d: str) -> DataFrame:
    """Detection and typing by the rules with each part switched off, against the delivered relations whose tail they share a
    text and place with."""
    c, e, o = rule_inputs(spark, d)
    at = ["case_id", "tail_start"]
    want = lexicon.best(tb.relations(spark, d, [*at, "relation", "score"]), at, ["-score", "rel_id"]).select(*at, F.lit(True).alias("is_relation"), F.col("relation").alias("gold_relation"))
    parts = ["word_class_backoff", "coordination", "negation", "transitions"]
    r = relate.ablated(c, e, "case_id", "case_text", {"all": o} | {p: replace(o, **{p: False}) for p in parts})
    every = ["without", *at]
    best = lexicon.best(r.select(*every, "relation", "score", "seq"), every, ["-score", "seq"])
    # every variant is judged against the same pairs
    names = F.explode(F.array(*map(F.lit, ["all", *parts]))).alias("without")
    n = evaluate.detection(evaluate.judged(want.select("*", names), best, every), ["without"])
    n = spark.range(1).select(names).join(n, "without", "left").fillna(0)
    return rounded(n.select(*[c for c in n.columns if c != "without"], "without"))


def v3_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.sweep(judged(spark, d, 0.0), [0.5 * k for k in range(9)]))


def v5_per_case(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.detection(judged(spark, d), ["case_id"]))


def v5_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(judged(spark, d))


def two_variants(spark: SparkSession, d: str) -> DataFrame:
    part = lambda x, least: evaluate.detection(judged(spark, d, least), ["case_id"]).select("case_id", *[F.col(c).alias(f"{x}_{c}") for c in ("tp", "fp", "fn", "f1")])
    return part("a", 0.5).join(part("b", 2.5), "case_id")


def v8_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """F1 difference of two thresholds by paired bootstrap over cases, in 200 draws as its SQL has it; v8_interval has all."""
    return resampled(spark, d, 200)


def v8_interval(spark: SparkSession, d: str) -> DataFrame:
    """The same in the 10,000 draws of the survey."""
    return resampled(spark, d, 10_000)


def resampled(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    return evaluate.bootstrap(cut(two_variants(spark, d)), rounds).select(*[F.round(c, 6).alias(c) for c in ("difference", "low", "high", "over_0")])


def v9_win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    w = evaluate.win_tie_loss(two_variants(spark, d), "a_f1", "b_f1")
    return w.withColumns({c: F.round(c, 6) for c in ("mean_a", "sd_a")})


def v10_who_is_right(spark: SparkSession, d: str) -> DataFrame:
    """Judged relations found by both thresholds, one or none."""
    a, b = judged(spark, d, 0.5).withColumnRenamed("predicted", "pa").drop("score"), judged(spark, d, 2.5).select(*PAIR, F.col("predicted").alias("pb"))
    same = [a[c].eqNullSafe(b[c]) for c in PAIR]
    j = a.join(b, same[0] & same[1] & same[2]).filter("is_relation")
    who = F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), "both").when(F.col("pa").isNotNull(), "a").when(F.col("pb").isNotNull(), "b").otherwise("none")
    return j.select("gold_relation", who.alias("who")).groupBy("gold_relation", "who").agg(F.count("*").alias("n"))


def v11_sample(spark: SparkSession, d: str) -> DataFrame:
    """20 cases spread over the number of their mentions."""
    n = tb.mentions(spark, d).groupBy("case_id").agg(F.count("*").alias("size"))
    return evaluate.stratified(n, "case_id", "size", 20)


def v12_left(spark: SparkSession, d: str) -> DataFrame:
    """Pairs not judged yet."""
    p = predicted(spark, d, -1e9).select(*PAIR)
    done = gold(spark, d).select(*PAIR)
    return p.join(done, PAIR, "left_anti")


def lm_scores(c: DataFrame) -> DataFrame:
    """(rel_id, lm_score) of candidates (rel_id, case_id, between, rule_path)."""
    c = c.select("rel_id", "case_id", ft.words("between").alias("w"), F.array_contains("rule_path", "clause").alias("yes"))
    part = lambda keep, name: association.held_out(c, "w", "rel_id", "case_id", c.filter(keep)).withColumnRenamed("logp", name)
    j = part(F.col("yes"), "a").join(part(~F.col("yes"), "b"), "rel_id")
    return j.select("rel_id", F.round(F.least(F.greatest(F.col("a") - F.col("b"), F.lit(-3.0)), F.lit(3.0)) / 3, 6).alias("lm_score"))


def n8_lm_score(spark: SparkSession, d: str) -> DataFrame:
    """How much likelier the words between the ends are among relations than among others, clipped to -1..1, without the
    rows of the same case."""
    return lm_scores(candidates(spark, d))


def f10_stacked(spark: SparkSession, d: str) -> DataFrame:
    """Structural features with the held-out language score as one more."""
    return features.structural(candidates(spark, d)).unionByName(n8_lm_score(spark, d).select("rel_id", F.lit("lm_score").alias("feature"), F.col("lm_score").alias("value")))


def f14_applied(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that the fixed weights take for relations, with their probability as score."""
    return f9_decided(spark, d).filter("class <> 'NENHUMA'").join(tb.relations(spark, d, ["case_id", "relation"]).drop("extracted_at"), "rel_id").select("rel_id", "case_id", "relation", F.col("probability").alias("score"))


def f14_learned(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that the learned models take for relations, typed by them: the score is the probability, triggers are
    blank and the path names the model. Of a pair (case, head, tail, relation) the best counts."""
    got = features.classified(variant(packed(feature_rows(spark, d)), "completo")).filter("class <> 'NENHUMA'").select(F.col("id").alias("rel_id"), "class", "probability")
    r = tb.relations(spark, d, ["case_id", "head_start", "tail_start", "relation"])
    rows = r.join(got, "rel_id").select("rel_id", *PAIR, F.col("class").alias("relation"), F.col("relation").alias("rule_relation"), F.round("probability", 3).alias("score"), F.lit("").alias("trigger_text"), F.lit("modelo").alias("rule_path"))
    return lexicon.best(rows, [*PAIR, "relation"], ["-score", "rel_id"])


#: Parts of the cases that are left out in turn.
FOLDS = 5


def v6_cross_validated(spark: SparkSession, d: str) -> DataFrame:
    """Detection and typing by each variant's models, fitted without the cases of the fold; folds by hash of the case."""
    f, out = packed(feature_rows(spark, d), FOLDS), None
    for v in VARIANTS:
        got = features.classified(variant(f, v), FOLDS)
        hit, true = F.col("class") != "NENHUMA", F.col("label") != "NENHUMA"
        n = got.groupBy("fold").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(hit & (F.col("class") == F.col("label"))).alias("typed")).withColumn("variant", F.lit(v))
        out = n if out is None else out.unionByName(n)
    return rounded(evaluate.prf(out))


def a2_variants(spark: SparkSession, d: str) -> DataFrame:
    """F1 of each fold by variant, side by side."""
    return v6_cross_validated(spark, d).groupBy("fold").pivot("variant", list(VARIANTS)).agg(F.first("f1"))


def v7_weakly_supervised(spark: SparkSession, d: str) -> DataFrame:
    """Models fitted on the rules' own decisions (relation where the score passes the threshold), without the cases of the
    fold, set against the judged labels: where models and rules agree, what the models recover and lose, which false
    relations they remove and which they add."""
    f = feature_rows(spark, d).drop("label")
    rule = tb.relations(spark, d, ["relation", "score"]).select(F.col("rel_id").alias("id"), F.when(F.col("score") >= 1.0, F.col("relation")).otherwise("NENHUMA").alias("label"))
    gold = candidates(spark, d).select(F.col("rel_id").alias("id"), F.array_contains("rule_path", "clause").alias("t"))
    j = features.classified(variant(packed(f.join(rule, "id"), FOLDS), "completo"), FOLDS).join(gold, "id")
    x, y, t, n = F.col("label") != "NENHUMA", F.col("class") != "NENHUMA", F.col("t"), F.count_if
    return j.agg(n(x == y).alias("agree"), n(t & ~x & y).alias("recovered"), n(t & x & ~y).alias("lost"), n(~t & x & ~y).alias("false_removed"), n(~t & ~x & y).alias("false_new"))


def v7_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What a stricter threshold changes: agreement, relations recovered and lost, false ones removed and new."""
    a, b = judged(spark, d, 2.5).withColumnRenamed("predicted", "pa").drop("score"), judged(spark, d, 0.5).select(*PAIR, F.col("predicted").alias("pb"))
    same = [a[c].eqNullSafe(b[c]) for c in PAIR]
    j = a.join(b, same[0] & same[1] & same[2])
    x, y, t = F.col("pa").isNotNull(), F.col("pb").isNotNull(), F.col("is_relation")
    n = F.count_if
    return j.agg(n(x == y).alias("agree"), n(t & ~x & y).alias("recovered"), n(t & x & ~y).alias("lost"), n(~t & x & ~y).alias("false_removed"), n(~t & ~x & y).alias("false_new"))



W_SQL = tb.sql("t") + f""", w AS (SELECT trecho_id, case_id, regexp_extract_all(lower(texto), '{WORD_SQL}') w FROM t), i AS (SELECT trecho_id, case_id, w, unnest(range(1, len(w) + 1)) i FROM w),
    u AS (SELECT w[i] w, count(*) f FROM i GROUP BY ALL), b AS (SELECT w[i] w1, w[i + 1] w2, count(*) c FROM i WHERE i < len(w) GROUP BY ALL),
    l AS (SELECT w1, sum(c) l FROM b GROUP BY ALL), r AS (SELECT w2, sum(c) r FROM b GROUP BY ALL), nn AS (SELECT (SELECT sum(c) FROM b)::double nb, (SELECT sum(f) FROM u)::double nu),
    k AS (SELECT w1, w2, c, x.f f1, y.f f2, nb, nu, c::double k11, (l - c)::double k12, (r - c)::double k21, nb - l - r + c k22 FROM b JOIN l USING (w1) JOIN r USING (w2) JOIN u x ON x.w = w1 JOIN u y ON y.w = w2, nn),
    a AS (SELECT w1, w2, c, log2((c / nb) / ((f1 / nu) * (f2 / nu))) pmi, 2 * (H(k11) + H(k12) + H(k21) + H(k22) - (H(k11 + k12) + H(k21 + k22)) - (H(k11 + k21) + H(k12 + k22)) + nb * ln(nb)) llr FROM k)"""
import re as _re  # noqa: E402

W_SQL = _re.sub(r"H\(([^()]*)\)", r"(CASE WHEN \1 > 0 THEN (\1) * ln(\1) ELSE 0 END)", W_SQL)
P_SQL = tb.sql("t") + f""", w AS (SELECT trecho_id, case_id, list_concat(['<s>'], regexp_extract_all(lower(texto), '{WORD_SQL}'), ['</s>']) w FROM t WHERE FILT), i AS (SELECT trecho_id, case_id, w, unnest(range(1, len(w) + 1)) i FROM w)"""
LEX = "(" + ", ".join(f"'{x}'" for x in LEXICON) + ")"
FW = "(" + ", ".join(f"'{x}'" for x in FUNCTION_WORDS) + ")"
CAND_SQL = tb.sql("r", "c") + """, x AS (SELECT r.*, case_text, coalesce(head_start, -1) hs, coalesce(head_end, -1) he, coalesce(tail_start, -1) ts, coalesce(tail_end, -1) te, coalesce(sent_start, -1) ss FROM r JOIN c USING (case_id)),
    y AS (SELECT *, CASE WHEN hs < 0 THEN ss WHEN hs <= ts THEN he ELSE te END lo, CASE WHEN hs < 0 OR hs <= ts THEN ts ELSE hs END hi FROM x),
    z AS (SELECT *, CASE WHEN hi > lo THEN substring(case_text, lo + 1, hi - lo) ELSE '' END between_ FROM y)"""
FEAT_SQL = CAND_SQL + """, f AS (SELECT rel_id, unnest([{'f': 'par:' || coalesce(head_entity_type, 'Person') || '|' || tail_entity_type, 'v': 1.0::double}, {'f': 'tipo_cabeca:' || coalesce(head_entity_type, 'Person'), 'v': 1.0}, {'f': 'tipo_cauda:' || tail_entity_type, 'v': 1.0},
        {'f': 'distancia:' || CASE WHEN token_gap = 0 THEN '0' WHEN token_gap <= 3 THEN '1_3' WHEN token_gap <= 10 THEN '4_10' ELSE 'mais_10' END, 'v': 1.0}, {'f': 'n_palavras_entre', 'v': least(token_gap, 20) / 20.0::double},
        {'f': CASE WHEN same_clause THEN 'mesma_clausula' END, 'v': 1.0}, {'f': CASE WHEN head_kind = 'Person' THEN 'paciente_cabeca' END, 'v': 1.0}, {'f': CASE WHEN contains(between_, ',') THEN 'tem_virgula' END, 'v': 1.0}]) s FROM z),
    fs AS (SELECT rel_id, s.f feature, s.v "value" FROM f WHERE s.f IS NOT NULL)"""


def judged_sql(least: float, name: str = "j") -> str:
    return f"""{name} AS (SELECT g.*, p.relation predicted, p.score FROM gold g LEFT JOIN (SELECT case_id, head_start, tail_start, CASE WHEN trigger_category = 'LOCATE' THEN 'LOCATED_IN' ELSE relation END relation, score FROM r WHERE score >= {least}
        QUALIFY row_number() OVER (PARTITION BY case_id, head_start, tail_start ORDER BY score DESC, rel_id) = 1) p USING (case_id, head_start, tail_start))"""


GOLD_SQL = tb.sql("r") + """, gold AS (SELECT case_id, head_start, tail_start, list_contains(rule_path, 'clause') is_relation, relation gold_relation FROM r WHERE assertion_status <> 'not_assessed' QUALIFY row_number() OVER (PARTITION BY case_id, head_start, tail_start ORDER BY score DESC, rel_id) = 1), """
COUNT_SQL = "count(*) FILTER (WHERE predicted IS NOT NULL AND is_relation) tp, count(*) FILTER (WHERE predicted IS NOT NULL AND NOT is_relation) fp, count(*) FILTER (WHERE predicted IS NULL AND is_relation) fn"
TYPED_SQL = COUNT_SQL + ", count(*) FILTER (WHERE is_relation AND predicted = gold_relation) typed"
PRF_SQL = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6)::double AS \"precision\", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6)::double recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::double * tp / (2 * tp + fp + fn) END, 6)::double f1"
F1 = "CASE WHEN 2 * {0}tp + {0}fp + {0}fn = 0 THEN 0 ELSE 2.0::double * {0}tp / (2 * {0}tp + {0}fp + {0}fn) END"
TWO_SQL = GOLD_SQL + judged_sql(0.5, "ja") + ", " + judged_sql(2.5, "jb") + f""", ca AS (SELECT case_id, {COUNT_SQL} FROM ja GROUP BY case_id), cb AS (SELECT case_id, {COUNT_SQL} FROM jb GROUP BY case_id),
    cc AS (SELECT case_id, ca.tp a_tp, ca.fp a_fp, ca.fn a_fn, cb.tp b_tp, cb.fp b_fp, cb.fn b_fn FROM ca JOIN cb USING (case_id))"""
SQL = {
    "n2_association": W_SQL + "SELECT w1, w2, c, round(pmi, 6) pmi, round(llr, 4) llr FROM a WHERE c >= 5",
    "n4_top_pmi": W_SQL + "SELECT w1, w2, c, round(pmi, 6) pmi FROM a WHERE c >= 5 ORDER BY 4 DESC, w1, w2 LIMIT 40",
    "n5_table": tb.sql("t", "c") + f""", g AS (SELECT 1 k, regexp_extract_all(lower(texto), '{WORD_SQL}') w FROM t UNION ALL SELECT 2, regexp_extract_all(lower(case_text), '{WORD_SQL}') FROM c), i AS (SELECT k, w, unnest(range(1, len(w))) i FROM g)
        SELECT w[i] || ' ' || w[i + 1] gram, count(*) FILTER (WHERE k = 1) AS "between", count(*) FILTER (WHERE k = 2) corpus FROM i GROUP BY gram HAVING count(*) >= 2""",
    "n7_log_probability": P_SQL.replace("FILT", "true") + """, u AS (SELECT w[i] w, count(*) f FROM i GROUP BY ALL), b AS (SELECT w[i] w1, w[i + 1] w2, count(*) c FROM i WHERE i < len(w) GROUP BY ALL), s AS (SELECT count(*) + 1 v, sum(f) n FROM u)
        SELECT trecho_id, round(avg(ln(0.7::double * (c + 0.4::double) / (x.f + 0.4::double * v) + 0.3::double * (y.f + 0.4::double) / (n + 0.4::double * v))), 6) logp FROM i JOIN b ON b.w1 = w[i] AND b.w2 = w[i + 1] JOIN u x ON x.w = b.w1 JOIN u y ON y.w = b.w2, s WHERE i < len(i.w) GROUP BY trecho_id""",
    "n9_held_out": P_SQL.replace("FILT", "case_id IS NOT NULL") + """, u AS (SELECT w[i] w, count(*) f FROM i GROUP BY ALL), b AS (SELECT w[i] w1, w[i + 1] w2, count(*) c FROM i WHERE i < len(w) GROUP BY ALL),
        ou AS (SELECT case_id, w[i] w, count(*) f FROM i GROUP BY ALL), ob AS (SELECT case_id, w[i] w1, w[i + 1] w2, count(*) c FROM i WHERE i < len(w) GROUP BY ALL),
        s AS (SELECT case_id, (SELECT count(*) FROM u) - count(*) FILTER (WHERE ou.f = u.f) + 1 v, (SELECT sum(f) FROM u) - sum(ou.f) n FROM ou JOIN u USING (w) GROUP BY case_id)
        SELECT trecho_id, round(avg(ln(0.7::double * (b.c - ob.c + 0.4::double) / (x.f - ox.f + 0.4::double * v) + 0.3::double * (y.f - oy.f + 0.4::double) / (n + 0.4::double * v))), 6) logp FROM i JOIN b ON b.w1 = w[i] AND b.w2 = w[i + 1] JOIN ob ON ob.case_id = i.case_id AND ob.w1 = b.w1 AND ob.w2 = b.w2
            JOIN u x ON x.w = b.w1 JOIN u y ON y.w = b.w2 JOIN ou ox ON ox.w = b.w1 AND ox.case_id = i.case_id JOIN ou oy ON oy.w = b.w2 AND oy.case_id = i.case_id JOIN s ON s.case_id = i.case_id WHERE i < len(i.w) GROUP BY trecho_id""",
    "n10_triggers": W_SQL + f"SELECT w1, w2, c, round(pmi, 6) pmi, round(llr, 4) llr, w1 IN {LEX} OR w2 IN {LEX} AS in_lexicon FROM a WHERE c >= 3 AND w1 NOT IN {FW}",
    "a4_between": W_SQL + f"SELECT w1, w2, c, w1 IN {LEX} OR w2 IN {LEX} AS in_lexicon FROM a WHERE c >= 3 AND w1 NOT IN {FW} ORDER BY c DESC, w1, w2 LIMIT 40",
    "a7_gold": GOLD_SQL.rstrip().rstrip(",") + " SELECT gold_relation, count(*) n, count(*) FILTER (WHERE is_relation) held FROM gold GROUP BY ALL",
    "v2_assertions": tb.sql("r") + """, g AS (SELECT case_id, head_start, tail_start, list_contains(rule_path, 'clause') is_relation, assertion_status gold_assertion FROM r WHERE assertion_status <> 'not_assessed' QUALIFY row_number() OVER (PARTITION BY case_id, head_start, tail_start ORDER BY score DESC, rel_id) = 1),
        p AS (SELECT case_id, head_start, tail_start, assertion_status FROM r WHERE score >= 1.0 QUALIFY row_number() OVER (PARTITION BY case_id, head_start, tail_start ORDER BY score DESC, rel_id) = 1)
        SELECT gold_assertion, count(*) hits, count(*) FILTER (WHERE assertion_status = gold_assertion) AS "right", round(count(*) FILTER (WHERE assertion_status = gold_assertion) / count(*), 6) accuracy FROM g JOIN p USING (case_id, head_start, tail_start) WHERE is_relation GROUP BY ALL""",
    "a7_hapax": W_SQL + "SELECT count(*) grams, count(*) FILTER (WHERE c = 1) hapax, round(count(*) FILTER (WHERE c = 1) / count(*), 6) share FROM b",
    "f1_between": CAND_SQL + "SELECT rel_id, between_ AS \"between\" FROM z",
    "f2_structural": FEAT_SQL + "SELECT * FROM fs",
    "f3_association": W_SQL + ", d AS (SELECT DISTINCT trecho_id, w[i] w1, w[i + 1] w2 FROM i WHERE i < len(w)), q AS (SELECT trecho_id, CASE WHEN c >= 5 THEN pmi ELSE 0 END pmi, llr FROM d JOIN a USING (w1, w2)) SELECT trecho_id, round(max(pmi) / 12, 6) pmi_max, round(avg(pmi) / 12, 6) pmi_mean, round(least(max(llr) / 300, 1.0::double), 6) llr_max FROM q GROUP BY ALL",
    "f4_ngram_features": CAND_SQL + f", w AS (SELECT rel_id, regexp_extract_all(lower(between_), '{WORD_SQL}') w FROM z), i AS (SELECT rel_id, w, unnest(range(1, len(w))) i FROM w), g AS (SELECT DISTINCT rel_id, w[i] || ' ' || w[i + 1] gram FROM i) SELECT * FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(*) >= 2)",
    "f5_gold": GOLD_SQL + judged_sql(1.0) + " SELECT * FROM j",
    "f6_weak_labels": KEYED_SQL + "SELECT case_id, head_start, tail_start, relation, CASE WHEN score >= 1.0 THEN relation ELSE 'NENHUMA' END AS label FROM k",
    "f9_decided": FEAT_SQL + """, w(class, feature, weight) AS (VALUES ('REL', 'mesma_clausula', 1.2::double), ('REL', 'distancia:1_3', 1.0), ('REL', 'distancia:mais_10', -1.5), ('NENHUMA', 'n_palavras_entre', 2.0), ('NENHUMA', 'paciente_cabeca', 0.5)), b(class, bias) AS (VALUES ('REL', -0.5::double), ('NENHUMA', 0.1)),
        s AS (SELECT rel_id, w.class, sum("value" * weight) s FROM fs JOIN w USING (feature) GROUP BY ALL), zz AS (SELECT i.rel_id, b.class, 1 / (1 + exp(-(coalesce(s, 0) + bias))) p FROM (SELECT DISTINCT rel_id FROM fs) i CROSS JOIN b LEFT JOIN s ON s.rel_id = i.rel_id AND s.class = b.class)
        SELECT rel_id, class, round(p / t, 6) probability FROM (SELECT *, sum(p) OVER (PARTITION BY rel_id) t FROM zz) QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY p DESC, class) = 1""",
    "v1_detection": GOLD_SQL + judged_sql(1.0) + f", n AS (SELECT {TYPED_SQL} FROM j) SELECT *, {PRF_SQL} FROM n",
    "v2_per_relation": GOLD_SQL + judged_sql(1.0) + f""", n AS (SELECT relation, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn FROM (
        SELECT gold_relation relation, (predicted IS NOT DISTINCT FROM gold_relation)::int tp, 0 fp, (predicted IS DISTINCT FROM gold_relation)::int fn FROM j WHERE is_relation
        UNION ALL SELECT predicted, 0, 1, 0 FROM j WHERE predicted IS NOT NULL AND NOT (is_relation AND predicted = gold_relation)) GROUP BY relation) SELECT *, {PRF_SQL} FROM n""",
    "v3_sweep": GOLD_SQL + judged_sql(0.0) + f", x AS (SELECT j.* REPLACE (CASE WHEN score >= k * 0.5 THEN predicted END AS predicted), k * 0.5::double threshold FROM j, range(9) t(k)), n AS (SELECT threshold, {TYPED_SQL} FROM x GROUP BY threshold) SELECT *, {PRF_SQL} FROM n",
    "v5_per_case": GOLD_SQL + judged_sql(1.0) + f", n AS (SELECT case_id, {TYPED_SQL} FROM j GROUP BY case_id) SELECT *, {PRF_SQL} FROM n",
    "v5_confusion": GOLD_SQL + judged_sql(1.0) + " SELECT CASE WHEN is_relation THEN gold_relation ELSE 'NENHUMA' END gold, coalesce(predicted, 'NENHUMA') predicted, count(*) n FROM j GROUP BY ALL",
    "v8_bootstrap": TWO_SQL + f""", o AS (SELECT *, row_number() OVER (ORDER BY case_id) - 1 i FROM cc), n AS (SELECT count(*) n FROM cc), dr AS (SELECT b, ('0x' || left(md5(b || ':' || k), 12))::bigint % n.n i FROM range(200) x(b), n, range(n.n) y(k)),
        s AS (SELECT b, sum(a_tp) a_tp, sum(a_fp) a_fp, sum(a_fn) a_fn, sum(b_tp) b_tp, sum(b_fp) b_fp, sum(b_fn) b_fn FROM dr JOIN o USING (i) GROUP BY b), q AS (SELECT list_sort(list({F1.format('a_')} - {F1.format('b_')})) v FROM s),
        w AS (SELECT sum(a_tp) a_tp, sum(a_fp) a_fp, sum(a_fn) a_fn, sum(b_tp) b_tp, sum(b_fp) b_fp, sum(b_fn) b_fn FROM cc)
        SELECT round({F1.format('a_')} - {F1.format('b_')}, 6) difference, round(v[6], 6) low, round(v[195], 6) high, round(len(list_filter(v, lambda x: x > 0)) / 200.0::double, 6) over_0 FROM w, q""",
    "v9_win_tie_loss": TWO_SQL + f", x AS (SELECT {F1.format('a_')} a, {F1.format('b_')} b FROM cc) SELECT count(*) FILTER (WHERE a - b > 1e-9) wins, count(*) FILTER (WHERE abs(a - b) <= 1e-9) ties, count(*) FILTER (WHERE a - b < -1e-9) losses, round(avg(a), 6) mean_a, round(stddev_pop(a), 6) sd_a FROM x",
    "v10_who_is_right": GOLD_SQL + judged_sql(0.5, "ja") + ", " + judged_sql(2.5, "jb") + " SELECT ja.gold_relation, CASE WHEN ja.predicted IS NOT NULL AND jb.predicted IS NOT NULL THEN 'both' WHEN ja.predicted IS NOT NULL THEN 'a' WHEN jb.predicted IS NOT NULL THEN 'b' ELSE 'none' END who, count(*) n FROM ja JOIN jb ON ja.case_id = jb.case_id AND ja.head_start IS NOT DISTINCT FROM jb.head_start AND ja.tail_start IS NOT DISTINCT FROM jb.tail_start WHERE ja.is_relation GROUP BY ALL",
    "f14_applied": FEAT_SQL + """, w(class, feature, weight) AS (VALUES ('REL', 'mesma_clausula', 1.2::double), ('REL', 'distancia:1_3', 1.0), ('REL', 'distancia:mais_10', -1.5), ('NENHUMA', 'n_palavras_entre', 2.0), ('NENHUMA', 'paciente_cabeca', 0.5)), b(class, bias) AS (VALUES ('REL', -0.5::double), ('NENHUMA', 0.1)),
        s AS (SELECT rel_id, w.class, sum("value" * weight) s FROM fs JOIN w USING (feature) GROUP BY ALL), zz AS (SELECT i.rel_id, b.class, 1 / (1 + exp(-(coalesce(s, 0) + bias))) p FROM (SELECT DISTINCT rel_id FROM fs) i CROSS JOIN b LEFT JOIN s ON s.rel_id = i.rel_id AND s.class = b.class),
        dd AS (SELECT rel_id, class, round(p / t, 6) score FROM (SELECT *, sum(p) OVER (PARTITION BY rel_id) t FROM zz) QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY p DESC, class) = 1)
        SELECT rel_id, r.case_id, r.relation, dd.score FROM dd JOIN r USING (rel_id) WHERE class <> 'NENHUMA'""",
    "v7_diagnostics": GOLD_SQL + judged_sql(2.5, "ja") + ", " + judged_sql(0.5, "jb") + """ SELECT count(*) FILTER (WHERE x = y) agree, count(*) FILTER (WHERE t AND NOT x AND y) recovered, count(*) FILTER (WHERE t AND x AND NOT y) lost, count(*) FILTER (WHERE NOT t AND x AND NOT y) false_removed, count(*) FILTER (WHERE NOT t AND NOT x AND y) false_new
        FROM (SELECT ja.predicted IS NOT NULL x, jb.predicted IS NOT NULL y, ja.is_relation t FROM ja JOIN jb ON ja.case_id = jb.case_id AND ja.head_start IS NOT DISTINCT FROM jb.head_start AND ja.tail_start IS NOT DISTINCT FROM jb.tail_start)""",
    "v11_sample": tb.sql("r", "o") + ", n AS (SELECT case_id, count(*) size FROM o GROUP BY case_id), k AS (SELECT *, row_number() OVER (ORDER BY size, case_id) - 1 r, count(*) OVER () n FROM n) SELECT case_id, size, r FROM k WHERE r IN (SELECT (i * (SELECT count(*) FROM n)) // 20 FROM range(20) t(i))",
    "v12_left": GOLD_SQL + "p AS (SELECT DISTINCT case_id, head_start, tail_start FROM r WHERE score >= -1e9) SELECT * FROM p ANTI JOIN gold USING (case_id, head_start, tail_start)",
}
SQL["v8_interval"] = SQL["v8_bootstrap"].replace("range(200)", "range(10000)").replace("v[6]", "v[251]").replace("v[195]", "v[9750]").replace("200.0", "10000.0")
QUERIES = {f.__name__: f for f in (n2_association, n4_top_pmi, n5_table, n7_log_probability, n9_held_out, n10_triggers, a4_between, a7_hapax, a7_gold, f1_between, f2_structural, f3_association, f4_ngram_features, f5_gold, f6_weak_labels, f7_weights, f9_weights, f9_decided, f10_stacked, f11_variants, f12_cross_checked, f13_top_weights, f14_applied, f14_learned, n8_lm_score, v6_cross_validated, a2_variants, v7_diagnostics, v7_weakly_supervised, v1_detection, v2_per_relation, v2_assertions, v4_ablations, v3_sweep, v5_per_case, v5_confusion, v8_bootstrap, v8_interval, v9_win_tie_loss, v10_who_is_right, v11_sample, v12_left)}
