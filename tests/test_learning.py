"""Association, language model, weights and measures on hand-made counts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import association, evaluate, features, graph, ontology


def docs(spark, rows):
    return spark.createDataFrame([(i, str(c), w.split()) for i, (c, w) in enumerate(rows)], "id int, fold string, w array<string>")


def test_pmi_by_hand(spark):
    d = docs(spark, [(0, w) for w in ["x y p"] * 6 + ["q z"] * 6 + ["p q"] * 6])
    got = {(r["w1"], r["w2"]): r for r in association.association(d, "w").collect()}
    assert got["x", "y"]["pmi"] == pytest.approx(math.log2((6 / 24) / (6 / 42) ** 2))
    assert association.association(docs(spark, [(0, "x y")]), "w").first()["pmi"] == 0
    b = docs(spark, [(0, w) for w in ["a b"] * 6 + ["a c"] * 6 + ["d b"] * 6 + ["d c"] * 6])
    assert all(abs(r["llr"]) < 1e-6 for r in association.association(b, "w").collect())


def test_language_model(spark):
    d = docs(spark, [(0, "a b"), (0, "a c"), (1, "b b a")])
    p = {r["id"]: r["logp"] for r in association.log_probability(d, d, "w", "id").collect()}
    assert all(v < 0 for v in p.values()) and len(p) == 3
    held = {r["id"]: r["logp"] for r in association.held_out(d, "w", "id", "fold").collect()}
    alone = {r["id"]: r["logp"] for r in association.log_probability(d.filter("fold = '0'"), d.filter("fold = '1'"), "w", "id").collect()}
    assert held[2] == pytest.approx(alone[2])
    alone = {r["id"]: r["logp"] for r in association.log_probability(d.filter("fold = '1'"), d.filter("fold = '0'"), "w", "id").collect()}
    assert held[0] == pytest.approx(alone[0]) and held[1] == pytest.approx(alone[1])


KINDS = "id int, feature string, value double, label string, fold int"


def test_one_vs_rest(spark):
    rng = random.Random(1)
    rows = [(i, f, 1.0, rng.choice("abc") if rng.random() < 0.1 else {"x": "a", "y": "b", "z": "c"}[f], i % 3) for i in range(600) for f in [rng.choice("xyz")]]
    df = spark.createDataFrame(rows, KINDS)
    w = features.one_vs_rest(df.drop("fold"))
    got = {r["id"]: r["class"] for r in features.applied(df.select("id", "feature", "value"), w).collect()}
    assert len(got) == 600 and all(got[i] == {"x": "a", "y": "b", "z": "c"}[f] for i, f, *_ in rows)
    # a fold's model is the one fitted without the fold
    part = {(r["class"], r["feature"]): r["weight"] for r in features.one_vs_rest(df, 3).filter("fold = 1").collect()}
    alone = {(r["class"], r["feature"]): r["weight"] for r in features.one_vs_rest(df.filter("fold <> 1").drop("fold")).collect()}
    assert part.keys() == alone.keys() and all(part[k] == pytest.approx(alone[k], abs=1e-6) for k in part)
    held = features.applied(df.select("id", "fold", "feature", "value"), features.one_vs_rest(df, 3))
    assert held.count() == 600
    assert features.one_vs_rest(spark.createDataFrame([], KINDS)).count() == 0


def test_fit_is_the_optimum(spark):
    """At the weights found, every gradient of the weighted, regularised likelihood is near zero."""
    rng = random.Random(2)
    x = {i: {f: rng.random() for f in rng.sample("abcde", 3)} for i in range(300)}
    y = {i: "yes" if sum(v * {"a": 3, "b": -2}.get(f, 0.2) for f, v in fs.items()) + rng.gauss(0, 0.5) > 0.3 else "no" for i, fs in x.items()}
    df = spark.createDataFrame([(i, f, v, y[i], 0) for i, fs in x.items() for f, v in fs.items()], KINDS)
    w = {r["feature"]: r["weight"] for r in features.one_vs_rest(df, rounds=3000, tolerance=1e-6).filter("class = 'yes'").collect()}
    n, pos = len(x), sum(v == "yes" for v in y.values())
    heavy = min(max((n - pos) / pos, 1), 20)
    for f in w:
        g = -1e-4 * w[f]
        for i, fs in x.items():
            z = w["(bias)"] + sum(w[k] * v for k, v in fs.items())
            g += (fs.get(f, 0) if f != "(bias)" else 1) * ((y[i] == "yes") - 1 / (1 + math.exp(-z))) * (heavy if y[i] == "yes" else 1) / n
        assert abs(g) < 1e-4


def test_model_tables(spark, tmp_path):
    from vellum.sources import files, sinks

    w = spark.createDataFrame([(0, "a", "f", 0.1), (0, "b", "f", -0.2)], "fold int, class string, feature string, weight double")
    sinks.write_model({"weights": w}, str(tmp_path / "m"))
    assert sorted(files.read_model(spark, str(tmp_path / "m"), ["weights"])["weights"].collect()) == sorted(w.collect())
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_model({"weights": w}, str(tmp_path / "m"))
    assert files.read_frequencies(spark, str(tmp_path / "none.csv")).count() == 0


def test_order_of_all_rows(spark):
    from vellum.operators.rank import ordered

    rows = [(f"k{i * 7919 % 1000:04d}",) for i in range(1000)]
    got = sorted((r["rank"], r["k"]) for r in ordered(spark.createDataFrame(rows, "k string"), ["k"]).collect())
    assert got == list(enumerate(sorted(k for k, in rows)))


def test_judged_pairs_must_be_candidates(spark):
    from vellum.operators import evaluate

    g = spark.createDataFrame([("a", True, "R"), ("b", True, "R")], "k string, is_relation boolean, gold_relation string")
    p = spark.createDataFrame([("a", "R", 1.0)], "k string, relation string, score double")
    assert evaluate.judged(g, p, ["k"], g.select("k")).count() == 2
    with pytest.raises(ValueError, match="no candidates"):
        evaluate.judged(g, p, ["k"], p.select("k"))


def test_between(spark):
    t = "A pelvic mass was identified by ultrasonography."
    df = spark.createDataFrame([(t, 13, 32, 2, 47, 0), (t, 47, 2, 32, 13, 0), (t, -1, 2, -1, 13, 0), (t, 5, 4, 3, 9, 0)], "t string, he int, ts int, hs int, te int, ss int")
    got = [r[0] for r in df.select(features.text_between(*[F.col(c) for c in ("t", "he", "ts", "hs", "te", "ss")])).collect()]
    assert got == [" was identified by ", " was identified by ", "A ", ""]


def test_measures(spark):
    g = spark.createDataFrame([(1, True, "T"), (2, True, "L"), (3, False, "T"), (4, True, "T")], "k int, is_relation boolean, gold_relation string")
    p = spark.createDataFrame([(1, "L", 1.0), (2, "L", 2.0), (3, "T", 0.5), (9, "T", 9.0)], "k int, relation string, score double")
    j = evaluate.judged(g, p, ["k"])
    r = evaluate.detection(j, []).first()
    assert (r["tp"], r["fp"], r["fn"], r["typed"]) == (2, 1, 1, 1)
    by = {r["relation"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.per_relation(j).collect()}
    assert by == {"T": (0, 1, 2), "L": (1, 1, 0)}
    assert {r["threshold"]: r["tp"] for r in evaluate.sweep(j, [0.0, 1.5]).collect()} == {0.0: 2, 1.5: 1}
    none = evaluate.detection(j.limit(0), []).first()
    assert none["f1"] == 0 and none["precision"] == 0


def test_bootstrap_of_equals(spark):
    c = spark.createDataFrame([(str(i), i, 1, 2, i, 1, 2) for i in range(8)], "case_id string, a_tp int, a_fp int, a_fn int, b_tp int, b_fp int, b_fn int")
    r = evaluate.bootstrap(c, 40).first()
    assert (r["difference"], r["low"], r["high"], r["over_0"]) == (0, 0, 0, 0)


def test_sample(spark):
    rows = [(f"c{i:02}", i % 4) for i in range(37)]
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    got = sorted(r["r"] for r in evaluate.stratified(spark.createDataFrame(rows, "k string, size int"), "k", "size", 5).collect())
    assert got == sorted({i * 37 // 5 for i in range(5)})
    assert {r["k"] for r in evaluate.stratified(spark.createDataFrame(rows, "k string, size int"), "k", "size", 5).collect()} == {want[i][0] for i in got}


def test_provenance_and_jaccard(spark):
    a = spark.createDataFrame([("T", 1, 1.0), ("L", 2, 1.0)], "relation string, k int, score double")
    b = spark.createDataFrame([("T", 1, 2.0), ("F", 3, 2.0)], "relation string, k int, score double")
    m = graph.merged(a, b, ["relation", "k"])
    assert {(r["relation"], r["origin"], r["score"]) for r in m.collect()} == {("T", "ambos", 2.0), ("L", "p1", 1.0), ("F", "p2", 2.0)}
    total = {r["relation"]: r for r in graph.compared(m).collect()}["TOTAL"]
    assert (total["p1"], total["p2"], total["both"]) == (2, 2, 1) and total["jaccard"] == pytest.approx(1 / 3)


def test_aggregated_edges(spark):
    r = spark.createDataFrame([("c", "R", "a", "b", 1.0, 2, "x", "p1"), ("c", "R", "a", "b", 3.0, 4, "y", "p2"), ("c", "R", "a", "b", 3.0, 3, "z", "p2"), ("c", "R", "a", "a", 1.0, 1, "x", "p1"), ("c", "R", None, "a", 1.0, 1, "x", "p1")], "case_id string, relation string, source string, target string, score double, seq int, status string, origin string")
    e = graph.aggregate(r).collect()
    assert len(e) == 1 and (e[0]["n"], e[0]["status"], e[0]["origin"]) == (3, "z", "ambos")
    n = spark.createDataFrame([("c", f"n{i}", i == 0, i, "l") for i in range(6)], "case_id string, node string, context boolean, n_mentions int, label string")
    edges = spark.createDataFrame([("c", f"n{i}", f"n{i + 1}") for i in range(5)], "case_id string, source string, target string")
    for most in (2, 3, 4, 100):
        kept, left = graph.filtered(n, edges, most)
        assert kept.count() <= most and graph.faults(kept, left).agg(F.sum("n")).first()[0] == 0


def test_ontology(spark):
    raw = spark.createDataFrame([("DRUG", "DIS", "may_be_treated_by", "S", 1), ("DIS", "DRUG", "may_treat", "S", 2), ("DIS", "DIS", "may_treat", "S", 3), ("DIS", "OUT", "may_treat", "S", 4), ("DIS", "DRUG", "isa", "S", 5)], "cui1 string, cui2 string, rela string, sab string, seq int")
    c = spark.createDataFrame([("DRUG",), ("DIS",)], "cui string")
    e = ontology.oriented_edges(raw, c)
    assert sorted((r["head_cui"], r["tail_cui"], r["relation"], r["seq"]) for r in e.collect()) == [("DIS", "DRUG", "TREATED_WITH", 1), ("DIS", "DRUG", "TREATED_WITH", 2)]
    assert [r["seq"] for r in ontology.first_edges(e).collect()] == [1]
    ents = spark.createDataFrame([("DIS", "Diagnosis"), ("DIS", "Diagnosis"), ("DIS", "Finding"), ("DRUG", "Treatment")], "cui string, entity_type string")
    p = ontology.type_prior(ontology.first_edges(e), ents).first()
    assert (p["head_type"], p["tail_type"], p["n"], p["prior"]) == ("Diagnosis", "Treatment", 1, 1.0)
