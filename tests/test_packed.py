"""Packed fields against a scanner that reads one character at a time."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vellum.operators.packed import unpack

STRONG = ";|\t\n\r、，；"


def elements(s, seps):
    """[(value, quoted)] of a packed string, read by hand."""
    out, i = [], 0
    while i <= len(s):
        j = i
        while j < len(s) and s[j] in " ":
            j += 1
        if j < len(s) and s[j] in "\"'":
            mark, k, buf = s[j], j + 1, ""
            while k < len(s):
                if s[k] == "\\" and k + 1 < len(s):
                    buf, k = buf + s[k + 1], k + 2
                elif mark == '"' and s[k : k + 2] == '""':
                    buf, k = buf + '"', k + 2
                elif s[k] == mark:
                    e = k + 1
                    while e < len(s) and s[e] == " ":
                        e += 1
                    if e == len(s) or s[e] in STRONG + ",":
                        out.append((buf, True))
                        i = e + 1
                        break
                    if mark == '"':
                        k = len(s)
                    else:
                        buf, k = buf + "'", k + 1
                else:
                    buf, k = buf + s[k], k + 1
            else:
                k = None
            if k is not None and k < len(s):
                continue
        e = i
        while e < len(s) and s[e] not in seps:
            e += 1
        out.append((s[i:e].strip(), False))
        i = e + 1
    return out


def brute(s, author):
    s = (s or "").strip()
    boxed = len(s) > 1 and s[0] + s[-1] in ("[]", "{}")
    s = s[1:-1].strip() if boxed else s
    bare = "".join("" if q else v + c for (v, q), c in zip(elements(s, STRONG + ","), "\0" * 999)) if s else ""
    outside = s
    for v, q in elements(s, STRONG + ","):
        if q:
            outside = outside.replace(v, "", 1)
    del bare
    strong = any(c in outside for c in STRONG)
    got = [(v.strip(), q) for v, q in elements(s, STRONG if strong else ",") if v.strip()]
    if author and not boxed and not strong and got and not got[-1][1]:
        parts = [p.strip() for p in re.split(r"(?:^|,?\s+)(?:and|AND|And|&)\s+(?=\S)", got[-1][0]) if p.strip()]
        got = got[:-1] + [(p, False) for p in parts]
    return [v for v, _ in got]


CASES = {
    "[A B, 'C, D', \"E; F\"]": ["A B", "C, D", "E; F"],
    '["so-called \\"x\\" y", "z"]': ['so-called "x" y', "z"],
    'a, "so-called ""x"" y",b, ': ["a", 'so-called "x" y', "b"],
    "O'Neil, 'D'Arcy, Jr', B": ["O'Neil", "D'Arcy, Jr", "B"],
    "X, Y;Z | W / V": ["X, Y", "Z", "W / V"],
    "a；b、c，d\r\ne\tf": ["a", "b", "c", "d", "e", "f"],
    "A B, C D, and E F": ["A B", "C D", "E F"],
    "A & B": ["A", "B"],
    "and B": ["B"],
    "[N and M Study Group]": ["N and M Study Group"],
    "[ , , a,, '' ]": ["a"],
    "": [], "   ": [], "[]": [], "[ ]": [], ";;": [],
    '"unclosed, a': ['"unclosed', "a"],
    "\u00010\u0001, 'q, r'": ["\u00010\u0001", "q, r"],
    "'x'": ["x"],
}


def values(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, authors string, value string")
    got = {}
    for r in unpack(df, ["id"], ["authors"]).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["value"])
        assert r["pos"] == len(got[r["id"]]) and r["field_name"] == "authors"
    return [got.get(i, []) for i in range(len(texts))]


def test_cases(spark):
    assert values(spark, list(CASES)) == list(CASES.values())


def test_null_and_empty_table(spark):
    assert values(spark, [None]) == [[]]
    assert unpack(spark.createDataFrame([], "id int, authors string"), ["id"], ["authors"]).count() == 0


def test_long_quote(spark):
    long = '"' + "x, " * 40_000 + '"'
    assert values(spark, [long + ", b"]) == [[("x, " * 40_000).strip(), "b"]]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.text("ab ,;'é/", min_size=1, max_size=8).map(lambda v: " ".join(v.split())).filter(lambda v: v.strip("' ")), min_size=1, max_size=5), min_size=1, max_size=30))
def test_quoted_round_trip(spark, lists):
    packed = ["[" + ", ".join('"' + v.replace('"', '""') + '"' for v in vs) + "]" for vs in lists]
    assert values(spark, packed) == lists


def test_scanner_agrees(spark):
    texts = [t for t in CASES if "\u0001" not in t and '"unclosed' not in t and "'q" not in t]
    assert values(spark, texts) == [brute(t, True) for t in texts]
