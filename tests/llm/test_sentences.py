"""Sentence units on hand-divided texts in nine languages, and the invariants of the division."""

import os
import random

import pyarrow.parquet as pq
import pytest

from vellum.llm import sentences as sn

DIVIDED = [
    "By 11 a.m. Dr. Foster saw mild pain, rash etc. and gave aspirin.| The dose rose to 20.8 mg.| pH was 7.33 while it stayed.",
    "Was it chronic fever, i.e. a late sign?!| Prof. H. J. Smith reviewed it (cf. Table 4. Scale of pain in mm.) for lupus.",
    "She felt “weak, tired and cold again.” |Weight was 5.3 kg.\n\n|Findings\n\n|About 33.2 mg. of it b.i.d. helped.|No space here.",
    "Der Herd maß ca. 9,6 cm (s. Abb. 13) und war rot.| Bis zum 12. Mai lag er. |Sie sagte: „Er wächst. Er bleibt.“ und nahm z. B. Tee usw.",
    "¿Había dolor?| ¡No hubo fiebre!| La Sra. Vega usó aprox. 22,2 mg.",
    "No 33.º dia, p. ex. o doente saiu.| A Sra. Lima voltou ... talvez de novo.",
    "Le patient dit : « Il va. Rien ne change. » puis sortit.| M. Petit vint.",
    "रोगी ने “दर्द बढ़ा। बुखार नहीं हुआ।” कहकर दवा ली।| डॉ. Kumar ने 9.5 मि.ग्रा. दिया.| क्या वह ठीक था?",
    "患者说“压痛。没有肿。”后用药。|无热,脉3.5缓……随后好转！|核窝？",
    "患者は「痛い。眠れない。」と述べた。|Dr. Satoは薬を出した．|潤隔か？",
    "ไม่พบไข้แต่ปวดหัว |หลัง 26 วันจึงนำส่ง |ค่าเท่ากับ 18.6 มก.จึงหยุดยา",
    "One line\nbreak stays here.|| Next one.\n \n|Last",
]


def cut(text):
    whole = text.replace("|", "")
    spans, at = [], 0
    for part in text.split("|"):
        if part.strip():
            lead = len(part) - len(part.lstrip())
            spans.append((at + lead, at + lead + len(part.strip())))
        at += len(part)
    return whole, spans


def texts():
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    found = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    return [r["text"] for r in sorted(found, key=lambda r: r["doc_id"]) if r["text"]]


@pytest.fixture(scope="module")
def weights():
    return sn.fit(sn.labelled(*sn.evidence(texts())))


def boundaries(weights):
    """(found, true, both) of the boundaries of DIVIDED."""
    n = [0, 0, 0]
    for text in DIVIDED:
        whole, want = cut(text)
        a, b = {e for _, e in sn.split(whole, weights)}, {e for _, e in want}
        n = [x + y for x, y in zip(n, (len(a), len(b), len(a & b)))]
    return n


def test_hand_divided(weights):
    """Sentences divided by hand, of other words than the training texts: training finds what the prior can't know."""
    found, true, both = boundaries(weights)
    assert both / true >= 0.93 and both / found >= 0.93
    found, true, untrained = boundaries(dict(sn.PRIOR))
    assert 2 * untrained / (found + true) < 0.9


def test_held_out_accuracy():
    """Reliable marks that training hasn't seen are classified as they are labelled; without training far fewer are."""
    every = texts()
    w = sn.fit(sn.labelled(*sn.evidence(every[::2])))
    held = [r for r in sn.labelled(*sn.evidence(every[1::2])) if r[1] + r[2]]
    right = lambda w: sum(p if sum(w.get(x, 0.0) for x in f) > 0 else q for f, p, q, _ in held) / sum(p + q for _, p, q, _ in held)
    assert right(w) > 0.985 > 0.9 > right(dict(sn.PRIOR))


def test_invariants():
    rng = random.Random(7)
    pieces = ["Dr. ", "A b. ", "“", "”", "(", ")", "。", "x", "\n", "\n\n", "\r\n\r\n", "3.5", "... ", "«", "»", '"', "ไทย ", "?!", " ", "\t", "é"]
    for _ in range(300):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        got = sn.split(t, dict(sn.PRIOR))
        covered = [False] * len(t)
        for a, b in got:
            assert t[a:b].strip() == t[a:b] != ""
            assert not any(covered[a:b])
            covered[a:b] = [True] * (b - a)
        assert all(c or ch.isspace() for c, ch in zip(covered, t))


def test_training_moves_the_prior():
    rows = [(("bias", "m=.", "w=zq"), 0, 40, 0), (("bias", "m=.", "w=*"), 60, 0, 0), (("bias", "m=.", "w=*", "n=d"), 0, 0, 9)]
    w = sn.fit(rows)
    score = lambda f: sum(w.get(x, 0.0) for x in f)
    assert score(rows[0][0]) < 0 < score(rows[1][0]) and score(rows[2][0]) > 0
    assert sn.fit([]) == sn.PRIOR


def test_abbreviations_come_from_counts():
    """A word that often stands before a period and never ends a paragraph is learned as an abbreviation of any language."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    known = [word() for _ in range(300)]
    sentence = lambda: " ".join(["Zqx. " + word().title() if rng.random() < 0.5 else word().title(), *rng.choices(known, k=5)]) + "."
    w = sn.fit(sn.labelled(*sn.evidence("\n\n".join(" ".join(sentence() for _ in range(4)) for _ in range(3)) for _ in range(60))))
    assert [t for t in _units("Zqx. Bado came bido. Zqx. Kilo left rade.", w)] == ["Zqx. Bado came bido.", "Zqx. Kilo left rade."]


def _units(text, w):
    return [text[a:b] for a, b in sn.split(text, w)]


def test_frame(spark):
    texts = [(1, "One. Two."), (2, ""), (3, None), (4, "   "), (5, "a" * 200_000 + ". B."), (1, "One. Two.")]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "id int, text string, sent_start int")
    got = sorted(map(tuple, sn.sentences(df, "id", "text").collect()))
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (5, 0, 200_001), (5, 200_002, 200_004)]
    assert sn.sentences(df.limit(0), "id", "text").count() == 0
