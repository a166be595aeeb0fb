"""Repeated shares against a plain count, cutoffs against their guarantee."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from vellum.llm import repetition as rp


def plainly(hashes, width):
    """What repeated() gives for one text, by a set of tuples."""
    seen, words, covered = set(), hashes.tolist(), [False] * len(hashes)
    for i in range(len(words) - width + 1):
        run = tuple(words[i : i + width])
        if run in seen:
            covered[i : i + width] = [True] * width
        seen.add(run)
    return sum(covered)


def test_against_plain_count():
    rng = random.Random(3)
    texts = [np.array([rng.randint(0, k) for _ in range(rng.randint(0, 120))], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (1, 2, 5, 50) for _ in range(30)]
    n = np.array([len(t) for t in texts])
    for width in (6, 30):
        got = rp.repeated(np.concatenate(texts), n, width)
        assert got.tolist() == [plainly(t, width) for t in texts]


def test_frame(spark):
    s = "The quick brown fox jumps over the lazy dog near the river bank today. "
    zh = "患者肝脉软缘索层渗浸膜孔管囊漏压硬痛钝速群节核缩炎热斑肿窝轴锐肾骨"
    texts = {1: s * 4, 2: s, 3: "", 4: None, 5: zh * 3, 6: zh, 7: s.upper().replace(" ", "  ") + s, 8: "a b c"}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "id int, text string, words int")
    got = {r["id"]: r for r in rp.shares(df, "id", "text").collect()}
    assert got[1]["share"] == 0.75 and got[2]["share"] == 0 and got[7]["share"] == 0.5
    assert got[5]["share"] == pytest.approx(2 / 3) and got[6]["share"] == 0 and got[5]["stratum"] == "chinese-japanese"
    assert got[3]["words"] == got[4]["words"] == got[8]["repeated"] == 0
    assert rp.shares(df.limit(0), "id", "text").count() == 0


def test_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000)], "id int, text string")
    assert rp.shares(df, "id", "text").first()["share"] > 0.99


def test_bounds():
    assert rp.binomial_cdf(0, 59, 0.05) == pytest.approx(0.95**59)
    for k, n in ((0, 50), (3, 50), (10, 200)):
        b = rp.upper_bound(k, n, 0.05)
        assert rp.binomial_cdf(k, n, b) == pytest.approx(0.05, abs=1e-6)
    assert rp.upper_bound(5, 5, 0.05) == rp.upper_bound(0, 0, 0.05) == 1.0


def test_guarantee_holds():
    """Over repeated holdouts, a cutoff that rejects more than alpha of the good documents is chosen in at most delta."""
    rng, bad = np.random.default_rng(0), 0
    for _ in range(200):
        d = pd.DataFrame({"stratum": np.repeat(["a", "b"], 300), "share": rng.beta(1, 9, 600), "good": True})
        for r in rp.cutoffs(d, rp.GRID, alpha=0.05, delta=0.1).itertuples():
            bad += r.certified and (1 - r.cutoff) ** 9 > 0.05
    assert bad <= 0.1 * 200


def test_too_few_labels():
    d = pd.DataFrame({"stratum": ["a"] * 5, "share": [0.0] * 5, "good": [True] * 5})
    r = rp.cutoffs(d, rp.GRID).iloc[0]
    assert not r["certified"] and not r["pooled"] and r["cutoff"] is None
    # with the labels of a large stratum beside it, the small one takes the pooled cutoff
    more = pd.DataFrame({"stratum": ["b"] * 500, "share": [0.01] * 500, "good": [True] * 500})
    got = rp.cutoffs(pd.concat([d, more]), rp.GRID).set_index("stratum")
    assert got.loc["b", "certified"] and got.loc["a", "pooled"] and got.loc["a", "cutoff"] == got.loc["all", "cutoff"] == min(rp.GRID)
    assert rp.cutoffs(d.iloc[:0], rp.GRID).set_index("stratum").loc["all", "cutoff"] is None


def corpus(rng):
    w = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    return [(i, (lambda t: t * 3 if i % 10 == 0 else t)(w(40) + ". ")) for i in range(300)]


def test_judged(spark):
    measured, table = rp.judged(spark.createDataFrame(corpus(random.Random(1)), "id int, text string"), "id", "text")
    got = {r["id"] for r in measured.collect() if r["share"] >= r["cutoff"]}
    assert got == {i for i in range(300) if i % 10 == 0}
    assert table.first()["certified"]
    empty, none = rp.judged(spark.createDataFrame([], "id int, text string"), "id", "text")
    assert empty.count() == 0 and none.first()["cutoff"] is None


def test_cutoff_decides(spark, monkeypatch):
    """Other labels, other rows: where the labeller finds repeating documents good, the certificate takes the cutoff up and
    they aren't rejected any more."""
    df = spark.createDataFrame(corpus(random.Random(1)), "id int, text string")
    grid = [c for c in rp.GRID if c >= 0.3]
    rejected = lambda: rp.judged(df, "id", "text", grid)[0].filter("share >= cutoff").count()
    assert rejected() == 30
    real = rp.cutoffs
    monkeypatch.setattr(rp, "cutoffs", lambda labelled, *a: real(labelled.assign(good=True), *a))
    assert rejected() == 0


def test_labeller_is_no_score():
    """The labeller goes by paragraphs, sentences and phrases, in spaced and unspaced scripts."""
    line = "Fever persisted for nine days without any response."
    other = "A second finding, unlike the first, was seen on imaging of both lungs."
    assert rp.reads_well(line) and rp.reads_well("") and rp.reads_well(f"{line} {other}")
    assert not rp.reads_well(f"{line}\n{line}\n{other}") and not rp.reads_well(f"{line} {line} {line}")
    assert not rp.reads_well(" ".join(f"the patient was then seen {w}" for w in "now then later soon after before once twice".split()))
    zh = "患者肝脉软缘索层渗浸膜孔管囊漏压硬痛钝速群节核缩炎热斑肿窝轴锐肾骨"
    assert rp.reads_well(zh) and not rp.reads_well(zh * 3)


def test_all_documents_decide(spark):
    """Cutoffs come from every document, not from some of them: the counts are those of the corpus, also of a rare script."""
    rows = [(i, "กขค" * 4 if i % 90 == 0 else f"document {i} holds a few words") for i in range(9_000)] + [(-i, "one same line. " * 9) for i in range(1, 301)]
    measured, table = rp.judged(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    got = {r["stratum"]: r for r in table.collect()}
    assert {s: r["good"] for s, r in got.items()} == {"ascii": 8_900, "thai": 100, "all": 9_000}
    assert got["thai"]["certified"] and not got["thai"]["pooled"]
    # the same cutoffs as from one row a document
    label = {"one same line. " * 9: False}
    plain = measured.join(spark.createDataFrame(rows, "id int, text string"), "id").select("stratum", "share", "text").toPandas()
    want = rp.cutoffs(plain.assign(good=[label.get(t, True) for t in plain["text"]]), rp.GRID)
    assert [tuple(r) for r in table.collect()] == [tuple(r) for r in want.itertuples(index=False)]


def test_binomial_of_large_counts():
    for n, p in ((60, 0.05), (400, 0.3), (400, 0.97)):
        plain = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        for k in (0, 1, n // 20, n // 2, n - 1, n):
            assert rp.binomial_cdf(k, n, p) == pytest.approx(sum(plain[: k + 1]), rel=1e-9)
    assert rp.binomial_cdf(50_000_000, 1_000_000_000, 0.05) == pytest.approx(0.5, abs=1e-4)


def plainly_well(text):
    """The labeller's rules by a count of tuples."""
    normal = rp.tokens.normal(text)
    if rp.again([p.strip() for p in re.split(r"[\r\n]+", normal) if p.strip()]) >= 0.3 or rp.again([s.strip() for s in re.split(r"(?<=[.!?。！？।])\s*", normal.replace("\n", " ")) if s.strip()]) >= 0.3:
        return False
    spaceless = len(rp.UNSPACED.findall(normal)) * 2 > len(normal)
    words = [c for c in normal if not c.isspace()] if spaceless else normal.split()
    total = sum(map(len, words))
    for width, top in ((12 if spaceless else 4, True), (40 if spaceless else 10, False)):
        runs = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        n = Counter(runs)
        if top and any(c > 1 and c * sum(map(len, r)) >= 0.16 * total for r, c in n.items()):
            return False
        covered = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + width)}
        if not top and covered and sum(len(words[j]) for j in covered) >= 0.4 * total:
            return False
    return True


def test_labeller_against_plain_rules():
    """All texts at once give what each gives by itself."""
    rng, texts = random.Random(7), ["", " ", "."]
    for _ in range(600):
        own, sep = rng.choice(["ab", "abc. ", "肝脉软缘。索", "กข ค", "é1 x", "\n. a", "abcdefghijklmnopqrstuvwxyz"]), rng.choice(["", " ", "\n"])
        base = sep.join(rng.choice(own) for _ in range(rng.randint(0, rng.choice([5, 30, 300]))))
        texts.append(base + sep.join(rng.choice([base[: rng.randint(0, 90)], chr(rng.randint(97, 0x9000))]) for _ in range(rng.randint(0, 40))))
    want = [plainly_well(t) for t in texts]
    assert rp.well([rp.tokens.normal(t) for t in texts]).tolist() == want and 100 < sum(want) < len(want) - 100
    assert [rp.reads_well(t) for t in texts] == want
