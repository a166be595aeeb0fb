"""Queries of corpus cleaning, the gazetteer, tokens and n-grams, entities and measurements."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import association, corpus, graph, lexicon, relate, spans
from ..session import cut, table
from . import graphs
from . import tables as tb

# A concept and terms that name no entity.
EXCLUDED_CUIS = ("C2745965",)
EXCLUDED_TERMS = ("treatment", "follow-up", "diagnosis", "analysis", "procedures", "surgical", "consent was", "i did", "possible", "indicated", "oral")
DROPPED = ["ART00000001_01", "ART00000002_01", "ART00000003_01"]


def c1_dropped(spark: SparkSession, d: str) -> DataFrame:
    return tb.cases(spark, d, ["age", "gender"]).filter(~F.col("case_id").isin(DROPPED)).select("case_id", "age", "gender")


def fragment_groups(c: DataFrame) -> DataFrame:
    """Cases of one article as ordered fragments, articles with several cases only."""
    key = F.upper(F.trim("article_id"))
    g = c.select(key.alias("a"), "case_id").filter("a <> ''")
    n = g.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
    return g.join(n, "a", "left_semi").select(F.concat("a", F.lit("_P1")).alias("group_id"), "case_id", F.row_number().over(W.partitionBy("a").orderBy("case_id")).alias("pos"))


def c2_merged(spark: SparkSession, d: str) -> DataFrame:
    c = tb.cases(spark, d, ["article_id", "age", "gender", "case_text"])
    m = corpus.merge_fragments(c, fragment_groups(c))
    return m.select("group_id", "age", "gender", F.array_join("source_case_ids", "|").alias("source_case_ids"), F.sha2("case_text", 256).alias("text_sha256"))


def c3_without_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(corpus.without_boilerplate(F.col("text"))).alias("n_kept"))


def c4_digits(spark: SparkSession, d: str) -> DataFrame:
    return tb.cases(spark, d, ["case_text"]).select("case_id", F.length(ft.digits_for_words(F.col("case_text"))).alias("n_chars"))


def c5_demographics(spark: SparkSession, d: str) -> DataFrame:
    return corpus.demographics(tb.cases(spark, d, ["case_text"])).select("case_id", "found_age", "found_age_method", "found_gender", "found_gender_method")


def c7_gender(spark: SparkSession, d: str) -> DataFrame:
    return corpus.demographics(tb.cases(spark, d, ["case_text"])).select("case_id", "found_gender", "found_gender_method")


def c8_overridden(spark: SparkSession, d: str) -> DataFrame:
    o = spark.createDataFrame([(DROPPED[0], None, "Female"), (DROPPED[1], "44", None)], "case_id string, age string, gender string")
    return corpus.override(tb.cases(spark, d, ["age", "gender"]), o, "case_id").select("case_id", "age", "gender")


def c9_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The clean cases in the order of their ids."""
    return tb.cases(spark, d, ["article_id", "age", "gender"]).select("case_id", "article_id", "age", "gender").orderBy("case_id")


def c10_audit(spark: SparkSession, d: str) -> DataFrame:
    """Where ages and genders differ from upstream, by method."""
    c = tb.cases(spark, d, ["age", "age_upstream", "gender", "gender_upstream", "age_method", "gender_method"])
    n = lambda c: F.floor(F.expr(f"try_cast({c} as double)"))
    return c.groupBy("age_method", "gender_method").agg(F.count_if(n("age") != n("age_upstream")).alias("age_differs"), F.count_if(F.col("gender") != F.col("gender_upstream")).alias("gender_differs"), F.count("*").alias("n"))


def c11_span_faults(spark: SparkSession, d: str) -> DataFrame:
    """Delivered spans that don't hold their surface, or of no case."""
    m = tb.mentions(spark, d)
    return corpus.span_faults(m, tb.cases(spark, d, ["case_text"]), "start", "end", "surface").groupBy("fault").agg(F.count("*").alias("n"))


def g1_normalized(spark: SparkSession, d: str) -> DataFrame:
    n = tb.gazetteer(spark, d).select("term_pref").distinct().withColumn("norm", ft.normalize("term_pref"))
    return n.select("term_pref", "norm", ft.sort_key("norm").alias("sort_key"))


def g3_priority(spark: SparkSession, d: str) -> DataFrame:
    return tb.gazetteer(spark, d).select("term_norm", "cui", "vocabulary", "tty", ft.priority(F.col("vocabulary"), F.col("tty"), tb.VOCABULARIES).alias("rank")).distinct()


def kept(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.keep_terms(tb.gazetteer(spark, d), ["MEDLEX", "CLINVOC", "DXLIST", "DRUGIX", "LABCODE"], "LABCODE", ("ct",))


def g4_kept(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d).select("term_norm", "cui", "vocabulary", "tty").distinct()


def g5_best(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each term and concept."""
    order = ["priority", "coalesce(vocabulary, '')", "coalesce(tty, '')", "added_at", "coalesce(term_pref, '')"]
    return lexicon.best(kept(spark, d), ["term_norm", "cui"], order).select("term_norm", "cui", "priority", "vocabulary", "tty")


def g6_stop_terms(spark: SparkSession, d: str) -> DataFrame:
    return tb.gazetteer(spark, d).filter("is_stopterm").select("term_norm").distinct()


def g6_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Terms with the stop flag computed from a list of stop terms, whatever the delivered flag of the row says."""
    listed = table(spark, d, "gazetteer").filter("is_stopterm").select(F.col("term_norm").alias("stop")).distinct()
    t = tb.gazetteer(spark, d).select("term_norm", "cui").distinct()
    return lexicon.flagged(t, listed.withColumnRenamed("stop", "term_norm"))


#: Terms that a sound dictionary finds: as they stand, or in another order of words.
PROBES = ["fever", "Acute  Pancreatitis", "chronic fever", "rulsirema", "zolsirum", "malpyroma chronic", "treatment", "no such term"]


def g8_probes(spark: SparkSession, d: str) -> DataFrame:
    """How the dictionary finds probe terms: exactly, by their words in any order, or not; 8 of its own terms turned around are
    probed too."""
    own = tb.gazetteer(spark, d).filter("n_tokens = 2").select("term_norm").distinct().orderBy("term_norm").limit(8)
    turned = own.select(F.array_join(F.reverse(F.split("term_norm", " ")), " ").alias("probe"))
    probes = spark.createDataFrame([(p,) for p in PROBES], "probe string").unionByName(turned).withColumn("norm", ft.normalize("probe")).withColumn("sk", ft.sort_key("norm"))
    g = tb.gazetteer(spark, d)
    exact, loose = g.select(F.col("term_norm").alias("norm")).distinct().withColumn("x", F.lit(True)), g.select(F.col("sort_key").alias("sk")).distinct().withColumn("y", F.lit(True))
    found = F.when(F.col("x"), "exact").when(F.col("y"), "words").otherwise("none")
    return probes.join(exact, "norm", "left").join(loose, "sk", "left").select("probe", found.alias("found")).distinct()


def g7_statistics(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.statistics(kept(spark, d), "tui")


def g7_lengths(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d).groupBy("n_tokens").agg(F.count("*").alias("n"))


def x1_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document and the sum of their offsets."""
    return lexicon.windows(table(spark, d, "documents"), "doc_id", "text", 1, masked=False).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("start").alias("sum_start"), F.max("end").alias("last_end"))


def x3_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the case texts with their counts."""
    return tb.cases(spark, d, ["case_text"]).select(F.explode(ft.words("case_text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def snippet_words(spark: SparkSession, d: str) -> DataFrame:
    return tb.snippets(spark, d).select("trecho_id", "case_id", ft.words("texto").alias("w"))


def x4_ngrams(spark: SparkSession, d: str) -> DataFrame:
    w = snippet_words(spark, d)
    return association.counts(w, "w", 2).unionByName(association.counts(w, "w", 3)).filter("count >= 2")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary entities of the case texts, longest match."""
    return entities_of(spark, d, tb.cases(spark, d, ["case_text"]))


def entities_of(spark: SparkSession, d: str, cases: DataFrame) -> DataFrame:
    g = tb.gazetteer(spark, d).filter("retired_at is null")
    hits = lexicon.candidates(cases, "case_id", "case_text", g, tb.entity_types(spark), excluded_cuis=EXCLUDED_CUIS, excluded_terms=EXCLUDED_TERMS)
    return lexicon.longest(hits, "case_id")


def e1_windows(spark: SparkSession, d: str) -> DataFrame:
    """How many windows of each width the case texts have."""
    return lexicon.windows(tb.cases(spark, d, ["case_text"]), "case_id", "case_text").groupBy("n").agg(F.count("*").alias("windows"), F.countDistinct("joined").alias("distinct_windows"))


def e5_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("case_id", "start", "end", "surface", "norm", "cui", "entity_type", "n")


def e7_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """The 15 most frequent surfaces of each type."""
    n = entities(spark, d).groupBy("entity_type", F.lower("surface").alias("surface")).agg(F.count("*").alias("n"))
    return lexicon.ranked_by(n, ["entity_type"], [F.desc("n"), "surface"], 15)


def m1_measurements(spark: SparkSession, d: str) -> DataFrame:
    return spans.measurements(tb.cases(spark, d, ["case_text"]), "case_id", "case_text")


def m7_linked(spark: SparkSession, d: str) -> DataFrame:
    """Measurements with the entity each belongs to."""
    c = tb.cases(spark, d, ["case_text"])
    e = spans.numbered(entities(spark, d), spans.sentence_starts(c, "case_id", "case_text"), "case_id")
    return spans.link(spans.measurements(c, "case_id", "case_text"), e, "case_id")


def m9_counts(spark: SparkSession, d: str) -> DataFrame:
    return m7_linked(spark, d).groupBy("unit_category", "link_method").agg(F.count("*").alias("n"))


def rule_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, relate.Options]:
    """Texts, entities and options of the rules: how often the corpus has each word, and the priors of pairs of types that
    the ontology gives (a row a pair of types)."""
    prior = {(r["head_type"], r["tail_type"]): r["prior"] for r in graphs.o5_type_prior(spark, d).collect()}
    frequency = tb.cases(spark, d, ["case_text"]).select(F.explode(ft.words("case_text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return tb.cases(spark, d, ["case_text"]), entities(spark, d), relate.Options(frequency=frequency, prior=prior)


def r15_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations drawn from the case texts by the rules."""
    c, e, o = rule_inputs(spark, d)
    return relate.relations(c, e, "case_id", "case_text", o)


def r16_counts(spark: SparkSession, d: str) -> DataFrame:
    return r15_relations(spark, d).groupBy("relation", "assertion_status", "head_kind").agg(F.count("*").alias("n"))


def explain(relations: DataFrame, case_id: str) -> DataFrame:
    """The relations of one case in order, in words: ends, relation, what fired and the score."""
    end = lambda kind: F.coalesce(F.concat(F.col(f"{kind}_text"), F.lit(" ["), F.col(f"{kind}_start"), F.lit(":"), F.col(f"{kind}_end"), F.lit("]")), F.lit("patient"))
    line = F.concat(end("head"), F.lit(" -"), F.col("relation"), F.lit("-> "), end("tail"))
    return relations.filter(F.col("case_id") == case_id).select("case_id", "seq", line.alias("relation"), "assertion_status", "trigger_text", "score", F.array_join("rule_path", " ").alias("fired"))


def r16_explained(spark: SparkSession, d: str) -> DataFrame:
    """The relations of the first case, explained. The case is picked before its texts are read, so one case is worked on."""
    first = table(spark, d, "cases_clean").agg(F.min("case_id")).first()[0]
    c = tb.cases(spark, d, ["case_text"]).filter(F.col("case_id") == first)
    return explain(relate.relations(c, entities_of(spark, d, c), "case_id", "case_text"), first)


def r17_ablations(spark: SparkSession, d: str) -> DataFrame:
    """How many relations the rules draw with each part switched off."""
    c, e, o = rule_inputs(spark, d)
    e, out = cut(e), None
    for off in [None, "word_class_backoff", "coordination", "negation", "transitions"]:
        n = relate.relations(c, e, "case_id", "case_text", replace(o, **{off: False}) if off else o).groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("assertion_status") == "negated").alias("negated")).withColumn("without", F.lit(off or "all"))
        out = n if out is None else out.unionByName(n)
    return out


def t3_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose delivered clause flag holds, by gap."""
    return tb.relations(spark, d, ["same_clause", "token_gap"]).groupBy("token_gap").agg(F.count_if("same_clause").alias("same"), F.count("*").alias("n"))


def t4_word_classes(spark: SparkSession, d: str) -> DataFrame:
    """The words of the case texts with their class where they stand alone: listed, or by their ending."""
    return x3_words(spark, d).select("word", "n", relate.word_class(F.col("word"), F.lit(False)).alias("word_class"))


def t5_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Word classes with their words and occurrences, and how many of the occurrences the lists cover; the rest is guessed."""
    listed = F.col("word").isin(sorted({w for _, ws in relate.WORD_CLASSES for w in ws.split()}))
    return t4_word_classes(spark, d).groupBy("word_class").agg(F.count("*").alias("words"), F.sum("n").alias("occurrences"), F.sum(F.when(listed, F.col("n")).otherwise(0)).alias("listed"))


def a8_measurements(spark: SparkSession, d: str) -> DataFrame:
    """Of each concept with measurements: how many, and the least, middle and largest value, by unit."""
    value = F.expr("try_cast(replace(value, ',', '.') as double)")
    m = m7_linked(spark, d).filter("linked_cui is not null and value is not null").withColumn("v", value)
    return m.groupBy("linked_cui", "unit_norm").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.percentile("v", F.lit(0.5)).alias("middle"), F.max("v").alias("largest"))


def h8_measurements(spark: SparkSession, d: str) -> DataFrame:
    """Measurement nodes with the concept each hangs on; those found only by the wide window are of lower confidence."""
    m = m7_linked(spark, d)
    node = graph.node_id("measurement", "start", "end")
    return m.select("case_id", node.alias("node"), "surface", "unit_category", F.when(F.col("linked_cui").isNotNull(), graph.node_id("concept", "linked_cui")).alias("owner"), (F.col("link_method") == "window_fallback").alias("lower_confidence"))


def h14_owners(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of each owner, the first 10 named."""
    h = h8_measurements(spark, d).filter("owner is not null")
    first = F.array_join(F.slice(F.array_sort(F.collect_set("node")), 1, 10), " ")
    return h.groupBy("case_id", "owner").agg(F.count("*").alias("n"), first.alias("shown"))



WORD = r"[a-z][a-z\-']*-[0-9]+(?:[.,][0-9]+)*|[a-z][a-z\-']*|[0-9]+(?:[.,][0-9]+)*"
WORD_SQL = WORD.replace("'", "''")
TOKEN_SQL = ft.TOKEN.replace("'", "''")
NORM_SQL = "lower(trim({0}))"
for _b, _a in ft.DIALECT:
    NORM_SQL = f"replace({NORM_SQL}, '{_b}', '{_a}')"
NORM_SQL = f"regexp_replace(trim(regexp_replace(translate(regexp_replace({NORM_SQL}, 'is(ed|ation|ing|es)\\b', 'iz\\1', 'g'), '‐‑‘’', '--'''''), '\\s+', ' ', 'g')), '^x^', '')"
RANK_SQL = "coalesce(map {'MEDLEX': 0, 'CLINVOC': 1, 'DXLIST': 2, 'DRUGIX': 3, 'LABCODE': 4}[vocabulary], 9) * 10 + coalesce(map {'PT': 0, 'PN': 1, 'MH': 1, 'FN': 2, 'SY': 3, 'SYN': 3, 'AB': 6, 'IS': 7}[tty], 8)"
KEPT_SQL = tb.sql("g") + """, k AS (SELECT * FROM g WHERE cui IS NOT NULL AND trim(coalesce(tui, '')) <> '' AND vocabulary IN ('MEDLEX', 'CLINVOC', 'DXLIST', 'DRUGIX', 'LABCODE') AND coalesce(tty, '') NOT IN ('LG', 'HS')
    AND length(term_norm) >= 2 AND n_tokens <= 8 AND NOT (vocabulary = 'LABCODE' AND n_tokens = 1 AND term_norm <> 'ct') AND NOT regexp_matches(term_norm, '^[0-9.,\\s]+$') AND NOT regexp_matches(term_norm, '^[a-z][\\s-][0-9]+$')) """
MERGED_SQL = tb.sql("c") + """, f AS (SELECT *, upper(trim(article_id)) a, row_number() OVER (PARTITION BY upper(trim(article_id)) ORDER BY case_id) pos, count(*) OVER (PARTITION BY upper(trim(article_id))) n FROM c WHERE trim(article_id) <> '')
    SELECT a || '_P1' group_id, min_by(age, pos) FILTER (WHERE trim(age) <> '') age, coalesce(min_by(gender, pos) FILTER (WHERE lower(trim(gender)) NOT IN ('', 'unknown')), 'Unknown') gender,
        string_agg(case_id, '|' ORDER BY pos) source_case_ids, sha256(string_agg(case_text, E'\\n\\n' ORDER BY pos)) text_sha256 FROM f WHERE n > 1 GROUP BY a"""
GENDER_SQL = tb.sql("c") + """, p AS (SELECT case_id, regexp_replace(regexp_replace(coalesce(case_text, ''), '(?is)BOIL', ''), '(?is)BOIL', '') x FROM c),
    q AS (SELECT case_id, lower(regexp_extract(left(x, 350), '(?i)\\b(boy|girl|male|female|man|woman)\\b', 1)) w, len(regexp_extract_all(left(x, 1000), '(?i)\\b(?:she|her)\\b')) she, len(regexp_extract_all(left(x, 1000), '(?i)\\b(?:he|his|him)\\b')) he FROM p)
    SELECT case_id, CASE WHEN w IN ('boy', 'male', 'man') THEN 'Male' WHEN w <> '' THEN 'Female' WHEN she > he THEN 'Female' WHEN he > she THEN 'Male' ELSE 'Unknown' END found_gender,
        CASE WHEN w <> '' THEN 'opening-word' WHEN she <> he THEN 'pronoun-majority' ELSE 'not-found' END found_gender_method FROM q""".replace("BOIL", corpus.BOILERPLATE)
TOKENS_SQL = f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_SQL}|[^A-Za-z0-9]+')) x, generate_subscripts(regexp_extract_all(text, '{TOKEN_SQL}|[^A-Za-z0-9]+'), 1) i FROM documents),
    o AS (SELECT doc_id, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) e FROM p)
    SELECT doc_id, count(*) n_tokens, sum(e - length(x))::bigint sum_start, max(e)::int last_end FROM o WHERE regexp_matches(x, '^[A-Za-z0-9]') GROUP BY doc_id"""
CLASSES = {w: c for c, ws in reversed(relate.WORD_CLASSES) for w in ws.split()}
CLASS_SQL = "CASE WHEN regexp_matches(word, '^[0-9]') THEN 'NUM' " + " ".join(f"WHEN word IN ({', '.join(repr(w) for w in sorted(x for x, y in CLASSES.items() if y == c))}) THEN '{c}'" for c in sorted(set(CLASSES.values()))) + " WHEN suffix(word, 'ing') THEN 'NOUN' " + " ".join(f"WHEN suffix(word, '{s}') AND length(word) > {len(s) + 1} THEN '{c}'" for s, c in relate.SUFFIXES) + " ELSE 'NOUN' END"
CITED = r"""(?i:\[\s*(?:Figure|Fig|Table)[^\]]{0,40}\]|\(\s*(?:Figure|Fig|Table)s?\.?\s*[\dA-Za-z\-,\s]{0,20}\)|\b(?:Figure|Fig|Table)s?\.\s*\d+[a-z]?)"""
PIECES_SQL = f"'{CITED}|{TOKEN_SQL}|[^A-Za-z0-9\\[(]+|[\\[(]'"
WINDOWS_SQL = tb.sql("c", "g") + f""", p AS (SELECT case_id, case_text, unnest(regexp_extract_all(case_text, {PIECES_SQL})) x, generate_subscripts(regexp_extract_all(case_text, {PIECES_SQL}), 1) k FROM c),
    o AS (SELECT *, sum(length(x)) OVER (PARTITION BY case_id ORDER BY k) e FROM p),
    w AS (SELECT case_id, list(x ORDER BY k) w, list((e - length(x))::int ORDER BY k) s, list(e::int ORDER BY k) e FROM o WHERE regexp_full_match(x, '{TOKEN_SQL}') GROUP BY case_id),
    i AS (SELECT case_id, w, s, e, unnest(range(1, len(w) + 1)) i FROM w), v AS (SELECT *, unnest(range(1, 7)) n FROM i),
    win AS (SELECT case_id, i - 1 i, n, s[i] start, e[i + n - 1] "end", array_to_string(w[i:i + n - 1], ' ') joined FROM v WHERE i + n - 1 <= len(w))"""
SORTED_SQL = "array_to_string(list_sort(regexp_extract_all({0}, '[a-z0-9]+')), ' ')"
ENTITY_SQL = "WITH RECURSIVE" + WINDOWS_SQL[4:] + f""", gz AS (SELECT * FROM g WHERE retired_at IS NULL),
    ex AS (SELECT * FROM gz WHERE term_norm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term_norm ORDER BY coalesce(priority, 2147483647), cui IS NULL, cui, coalesce(term_pref, ''), coalesce(vocabulary, ''), coalesce(tty, '')) = 1),
    lo AS (SELECT * FROM gz WHERE sort_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sort_key ORDER BY coalesce(priority, 2147483647), cui IS NULL, cui, coalesce(term_pref, ''), coalesce(vocabulary, ''), coalesce(tty, '')) = 1),
    nw AS (SELECT *, {NORM_SQL.format('joined')} norm FROM win), kw AS (SELECT *, CASE WHEN n > 1 THEN {SORTED_SQL.format('norm')} END sk FROM nw),
    hit AS (SELECT case_id, i, kw.n, start, "end", norm, CASE WHEN ex.term_norm IS NOT NULL THEN ex.cui ELSE lo.cui END cui, CASE WHEN ex.term_norm IS NOT NULL THEN ex.tui ELSE lo.tui END tui,
        CASE WHEN ex.term_norm IS NOT NULL THEN ex.term_pref ELSE lo.term_pref END term_pref, CASE WHEN ex.term_norm IS NOT NULL THEN ex.is_stopterm ELSE lo.is_stopterm END is_stopterm
        FROM kw LEFT JOIN ex ON ex.term_norm = norm LEFT JOIN lo ON lo.sort_key = sk WHERE ex.term_norm IS NOT NULL OR lo.sort_key IS NOT NULL),
    ty(tui, entity_type) AS (VALUES {', '.join(f"('{t}', '{e}')" for e, ts in tb.TYPES.items() for t in ts)}),
    ok AS (SELECT h.*, substring(case_text, start + 1, "end" - start) surface, entity_type FROM hit h JOIN c USING (case_id) JOIN ty USING (tui)
        WHERE NOT coalesce(n = 1 AND upper(term_pref) = term_pref AND regexp_matches(term_pref, '[A-Z]') AND length(term_pref) <= 4 AND upper(substring(case_text, start + 1, "end" - start)) <> substring(case_text, start + 1, "end" - start), false)
            AND NOT coalesce(cui IN ('{"', '".join(EXCLUDED_CUIS)}'), false) AND NOT coalesce(is_stopterm, false) AND norm NOT IN ('{"', '".join(EXCLUDED_TERMS)}')),
    top AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY case_id, i ORDER BY n DESC) = 1),
    nx AS (SELECT case_id, i, n, lead_i FROM (SELECT t.case_id, t.i, t.n, (SELECT min(u.i) FROM top u WHERE u.case_id = t.case_id AND u.i >= t.i + t.n) lead_i FROM top t)),
    walk AS (SELECT case_id, min(i) i FROM top GROUP BY case_id UNION ALL SELECT w.case_id, nx.lead_i FROM walk w JOIN nx ON nx.case_id = w.case_id AND nx.i = w.i WHERE nx.lead_i IS NOT NULL),
    ent AS (SELECT top.* FROM walk JOIN top USING (case_id, i))"""
UNITS_SQL = "map {" + ", ".join(f"'{u}': '{k}'" for u, k in spans.CATEGORY.items()) + "}"
_N, _U = "[0-9]+(?:[.,][0-9]+)?", "(?:[A-Za-zµ]+(?:/[A-Za-z]+)?|°[A-Za-z]+|%)"
_LEAD = "(?i:" + "|".join(sorted(spans.LEADING_UNITS, key=len, reverse=True)) + ")"
SCAN_SQL = f"'{_N}\\s*[-–]\\s*{_N}\\s*{_U}|{_N}[\\s-]{{0,2}}{_U}|\\b{_LEAD}\\s+[0-9]+\\b|[A-Za-z]+|[0-9]|[^A-Za-z0-9]+'"
#: Measurements by pieces of the text: RE2 can't look ahead, so the unit is told from the letters after the number.
MEASURES = f""", pl AS (SELECT case_id, case_text, array_to_string(list_transform(regexp_extract_all(case_text, {PIECES_SQL}), lambda p: CASE WHEN regexp_full_match(p, '{CITED}') THEN repeat(' ', length(p)) ELSE p END), '') plain FROM c WHERE case_text IS NOT NULL),
    mp AS (SELECT case_id, case_text, unnest(regexp_extract_all(plain, {SCAN_SQL})) x, generate_subscripts(regexp_extract_all(plain, {SCAN_SQL}), 1) k FROM pl),
    mo AS (SELECT *, (sum(length(x)) OVER (PARTITION BY case_id ORDER BY k) - length(x))::int start, lead(x) OVER (PARTITION BY case_id ORDER BY k) nxt FROM mp),
    mr AS (SELECT *, regexp_full_match(x, '{_LEAD}\\s+[0-9]+') AS isl, regexp_full_match(x, '{_N}\\s*[-–]\\s*{_N}\\s*{_U}') AS is_range, regexp_extract(x, '{_U}$') run FROM mo WHERE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-zµ°%]')),
    mu AS (SELECT *, CASE WHEN isl THEN regexp_extract(x, '^[A-Za-z]+') WHEN {UNITS_SQL}[lower(run)] IS NOT NULL THEN run WHEN {UNITS_SQL}[lower(string_split(run, '/')[1])] IS NOT NULL THEN string_split(run, '/')[1] END unit FROM mr),
    me AS (SELECT *, CASE WHEN isl OR unit = run THEN length(x) ELSE length(x) - length(run) + length(unit) END w FROM mu WHERE unit IS NOT NULL
        AND NOT (NOT isl AND NOT is_range AND lower(unit) IN ('{"', '".join(spans.AGE_UNITS)}') AND unit = run AND regexp_matches(nxt || ' ', '^-?\\s?$|(?i)^-?\\s?old\\b') AND regexp_matches(substring(case_text, start + length(x) + 1, 8), '(?i)^-?\\s?old\\b'))),
    ms AS (SELECT case_id, start, start + w::int "end", substring(case_text, start + 1, w) surface, is_range, CASE WHEN is_range THEN NULL WHEN isl THEN regexp_extract(x, '[0-9]+$') ELSE regexp_extract(x, '^{_N}') END AS "value",
        CASE WHEN is_range THEN regexp_extract(x, '^{_N}') END range_low, CASE WHEN is_range THEN regexp_extract(x, '[-–]\\s*({_N})', 1) END range_high, unit, lower(unit) unit_norm, {UNITS_SQL}[lower(unit)] unit_category,
        len(regexp_extract_all(left(case_text, start), '[.!?]\\s+'))::int sent_no FROM me)"""
LINKED = """, es AS (SELECT ent.*, len(regexp_extract_all(left(case_text, start), '[.!?]\\s+')) sn FROM ent JOIN c USING (case_id)),
    pr AS (SELECT m.case_id, m.start, CASE WHEN e.sn = m.sent_no AND e."end" <= m.start THEN 1 WHEN e.sn = m.sent_no AND e.start - m."end" BETWEEN 0 AND 25 THEN 2 WHEN m.start - e."end" BETWEEN 0 AND 150 THEN 3 END tier, e.start es, e."end" ee, e.surface esf, e.entity_type et, e.cui ec FROM ms m JOIN es e USING (case_id)),
    bs AS (SELECT * FROM pr WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id, start ORDER BY tier, CASE WHEN tier = 2 THEN es ELSE -ee END) = 1),
    ml AS (SELECT ms.*, es linked_start, ee linked_end, esf linked_surface, et linked_type, ec linked_cui, CASE tier WHEN 1 THEN 'same_sentence' WHEN 2 THEN 'same_sentence_forward' WHEN 3 THEN 'window_fallback' ELSE 'none' END link_method FROM ms LEFT JOIN bs USING (case_id, start))"""
LINKED_SQL = ENTITY_SQL + MEASURES + LINKED
OWNED = ", hm AS (SELECT case_id, 'measurement:' || start || ':' || \"end\" node, surface, unit_category, 'concept:' || linked_cui AS owner, link_method = 'window_fallback' lower_confidence FROM ml)"
BOIL_SQL = f"regexp_replace(regexp_replace(coalesce({{0}}, ''), '(?is){corpus.BOILERPLATE}', ''), '(?is){corpus.BOILERPLATE}', '')"
_NUMBERS = ft.number_words()
_EVERY = "|".join(sorted(_NUMBERS, key=len, reverse=True))
NUMBERS_SQL = "map {" + ", ".join(f"'{w}': '{v}'" for w, v in _NUMBERS.items()) + "}"
DIGITS_SQL = f"array_to_string(list_transform(regexp_extract_all(left(@, 700), '(?i)(\\b(?:{_EVERY})\\b|[^A-Za-z]+|[A-Za-z]+)'), lambda p: coalesce({NUMBERS_SQL}[lower(p)], p)), '')"
_year = lambda x: "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '(?i){corpus.YEARS}', {k}), '')" for k in (1, 2, 3)) + ")"
_part = lambda a, b: f"coalesce(nullif(regexp_extract(op, '(?i){corpus.PART_YEARS}', {a}), ''), nullif(regexp_extract(op, '(?i){corpus.PART_YEARS}', {b}), ''))"
_plain = lambda x: f"CASE WHEN {x} = floor({x}) THEN floor({x})::bigint::varchar ELSE {x}::varchar END"
AGES_SQL = tb.sql("c") + f""", b AS (SELECT case_id, {BOIL_SQL.format('case_text')} x FROM c), z AS (SELECT case_id, x, left({DIGITS_SQL.replace('@', 'x')}, 700) dg FROM b), q AS (SELECT case_id, x, dg, left(dg, 70) op FROM z),
    y AS (SELECT *, {_year('op')}::double ye, {_year('dg')}::double wi, {_part(1, 3)}::double pn, lower({_part(2, 4)}) pu FROM q),
    a AS (SELECT case_id, x, CASE WHEN regexp_matches(op, '(?i)\\bnewborns?\\b|\\bneonat') THEN ['0', 'newborn-keyword'] WHEN regexp_matches(op, '(?i){corpus.AGE_RANGE}') THEN ['', 'range-detected']
        WHEN ye IS NOT NULL THEN [{_plain('ye')}, 'opening-year-old'] WHEN pn IS NOT NULL THEN [round_even(pn * CASE pu WHEN 'day' THEN 1.0::double WHEN 'week' THEN 7.0 ELSE 30.44 END / 365.25, 2)::varchar, 'opening-' || pu || '-old']
        WHEN regexp_matches(op, '(?i)\\bbaby\\s+(?:boy|girl)\\b') THEN ['0', 'baby-keyword'] WHEN wi IS NOT NULL THEN [{_plain('wi')}, 'fallback-anywhere'] ELSE ['', 'not-found'] END r FROM y),
    gd AS ({GENDER_SQL.replace("WITH ", "WITH ", 1)})
    SELECT a.case_id, r[1] found_age, r[2] found_age_method, found_gender, found_gender_method FROM a JOIN gd USING (case_id)"""
SQL = {
    "x1_tokens": TOKENS_SQL,
    "c3_without_boilerplate": f"SELECT doc_id, length({BOIL_SQL.format('text')})::int n_kept FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
    "c4_digits": tb.sql("c") + f"SELECT case_id, (length({DIGITS_SQL.replace('@', 'case_text')}) + greatest(length(case_text) - 700, 0))::int n_chars FROM c",
    "c5_demographics": AGES_SQL,
    "c9_sorted": tb.sql("c") + "SELECT case_id, article_id, age, gender FROM c",
    "g6_flagged": tb.sql("g") + "SELECT DISTINCT term_norm, cui, term_norm IN (SELECT term_norm FROM gazetteer WHERE is_stopterm) AS is_stop FROM g",
    "g8_probes": tb.sql("g") + f""", p AS (SELECT unnest({PROBES}) probe UNION ALL SELECT array_to_string(list_reverse(string_split(term_norm, ' ')), ' ') FROM (SELECT DISTINCT term_norm FROM g WHERE n_tokens = 2 ORDER BY 1 LIMIT 8)), n AS (SELECT probe, {NORM_SQL.format('probe')} norm FROM p)
        SELECT DISTINCT probe, CASE WHEN norm IN (SELECT term_norm FROM g) THEN 'exact' WHEN {SORTED_SQL.format('norm')} IN (SELECT sort_key FROM g) THEN 'words' ELSE 'none' END found FROM n""",
    "e1_windows": WINDOWS_SQL + "SELECT n::int n, count(*) windows, count(DISTINCT joined) distinct_windows FROM win GROUP BY n",
    "e5_entities": ENTITY_SQL + 'SELECT case_id, start, "end", surface, norm, cui, entity_type, n::int n FROM ent',
    "e7_surfaces": ENTITY_SQL + ", k AS (SELECT entity_type, lower(surface) surface, count(*) n FROM ent GROUP BY ALL) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, surface) <= 15",
    "m1_measurements": tb.sql("c") + MEASURES + " SELECT * FROM ms",
    "m7_linked": LINKED_SQL + " SELECT * FROM ml",
    "m9_counts": LINKED_SQL + " SELECT unit_category, link_method, count(*) n FROM ml GROUP BY ALL",
    "a8_measurements": LINKED_SQL + """ SELECT linked_cui, unit_norm, count(*) n, min(v) least, quantile_cont(v, 0.5) middle, max(v) largest FROM (SELECT *, try_cast(replace("value", ',', '.') AS double) v FROM ml WHERE linked_cui IS NOT NULL AND "value" IS NOT NULL) GROUP BY ALL""",
    "h8_measurements": LINKED_SQL + OWNED + " SELECT * FROM hm",
    "h14_owners": LINKED_SQL + OWNED + " SELECT case_id, owner, count(*) n, array_to_string(list_sort(list(DISTINCT node))[1:10], ' ') shown FROM hm WHERE owner IS NOT NULL GROUP BY ALL",
    "t5_coverage": tb.sql("c") + f", w AS (SELECT unnest(regexp_extract_all(lower(case_text), '{WORD_SQL}')) word FROM c), k AS (SELECT word, count(*) n, {CLASS_SQL} word_class FROM w GROUP BY word) SELECT word_class, count(*) words, sum(n)::bigint occurrences, coalesce(sum(n) FILTER (WHERE word IN ({', '.join(repr(w) for w in sorted(CLASSES))})), 0)::bigint listed FROM k GROUP BY word_class",
    "c1_dropped": tb.sql("c") + f"SELECT case_id, age, gender FROM c WHERE case_id NOT IN {tuple(DROPPED)}",
    "c2_merged": MERGED_SQL,
    "c7_gender": GENDER_SQL,
    "c8_overridden": tb.sql("c") + f"SELECT case_id, CASE WHEN case_id = '{DROPPED[1]}' THEN '44' ELSE age END age, CASE WHEN case_id = '{DROPPED[0]}' THEN 'Female' ELSE gender END gender FROM c",
    "c10_audit": tb.sql("c") + "SELECT age_method, gender_method, count(*) FILTER (WHERE floor(try_cast(age AS double)) <> floor(try_cast(age_upstream AS double))) age_differs, count(*) FILTER (WHERE gender <> gender_upstream) gender_differs, count(*) n FROM c GROUP BY ALL",
    "c11_span_faults": tb.sql("r", "o", "c") + """SELECT CASE WHEN c.case_id IS NULL OR case_text IS NULL THEN 'foreign' ELSE 'text' END fault, count(*) n FROM o LEFT JOIN c USING (case_id)
        WHERE c.case_id IS NULL OR case_text IS NULL OR substring(case_text, start + 1, "end" - start) <> surface GROUP BY ALL""",
    "g1_normalized": tb.sql("g") + f", n AS (SELECT DISTINCT term_pref, {NORM_SQL.format('term_pref')} norm FROM g) SELECT term_pref, norm, array_to_string(list_sort(regexp_extract_all(norm, '[a-z0-9]+')), ' ') sort_key FROM n",
    "g3_priority": tb.sql("g") + f"SELECT DISTINCT term_norm, cui, vocabulary, tty, {RANK_SQL} rank FROM g",
    "g4_kept": KEPT_SQL + "SELECT DISTINCT term_norm, cui, vocabulary, tty FROM k",
    "g5_best": KEPT_SQL + "SELECT term_norm, cui, priority, vocabulary, tty FROM k QUALIFY row_number() OVER (PARTITION BY term_norm, cui ORDER BY priority NULLS FIRST, coalesce(vocabulary, ''), coalesce(tty, ''), added_at NULLS FIRST, coalesce(term_pref, '')) = 1",
    "g6_stop_terms": "SELECT DISTINCT term_norm FROM gazetteer WHERE is_stopterm",
    "g7_statistics": KEPT_SQL + "SELECT tui, count(DISTINCT cui) n_cuis, count(*) n_terms, count(*) FILTER (WHERE n_tokens > 1) n_multiword, count(*) FILTER (WHERE is_stopterm) n_stop FROM k GROUP BY tui",
    "g7_lengths": KEPT_SQL + "SELECT n_tokens, count(*) n FROM k GROUP BY ALL",
    "x3_words": tb.sql("c") + f"SELECT unnest(regexp_extract_all(lower(case_text), '{WORD_SQL}')) word, count(*) n FROM c GROUP BY word",
    "x4_ngrams": tb.sql("t") + f""", w AS (SELECT trecho_id, regexp_extract_all(lower(texto), '{WORD_SQL}') w FROM t), i AS (SELECT w, unnest(range(1, len(w) + 1)) i FROM w)
        SELECT array_to_string(w[i:i + 1], ' ') gram, 2 n, count(*) count FROM i WHERE i + 1 <= len(w) GROUP BY gram HAVING count(*) >= 2
        UNION ALL SELECT array_to_string(w[i:i + 2], ' '), 3, count(*) FROM i WHERE i + 2 <= len(w) GROUP BY 1 HAVING count(*) >= 2""",
    "t4_word_classes": tb.sql("c") + f", w AS (SELECT unnest(regexp_extract_all(lower(case_text), '{WORD_SQL}')) word FROM c) SELECT word, count(*) n, {CLASS_SQL} word_class FROM w GROUP BY word",
    "t3_clauses": tb.sql("r") + "SELECT token_gap, count(*) FILTER (WHERE same_clause) same, count(*) n FROM r GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (c1_dropped, c2_merged, c3_without_boilerplate, c4_digits, c5_demographics, c7_gender, c8_overridden, c9_sorted, c10_audit, c11_span_faults, g1_normalized, g3_priority, g4_kept, g5_best, g6_stop_terms, g6_flagged, g8_probes, g7_statistics, g7_lengths, x1_tokens, x3_words, x4_ngrams, e1_windows, e5_entities, e7_surfaces, m1_measurements, m7_linked, m9_counts, r15_relations, r16_counts, r16_explained, r17_ablations, t3_clauses, t4_word_classes, t5_coverage, a8_measurements, h8_measurements, h14_owners)}
