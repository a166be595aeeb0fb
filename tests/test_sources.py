"""Readers and writers round trip."""

import io
import json
import zipfile

import pytest

from vellum.operators import lexicon
from vellum.sources import files, sinks
from vellum.streaming import incremental


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\r\nc', ["x", "y"]), (2, "", None), (3, None, [])], "id int, text string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "o"), ["id", "text", "l"])
    back = {r["id"]: (r["text"], r["l"]) for r in files.read_csv(spark, str(tmp_path / "o")).collect()}
    assert back == {"1": ('a "q", b\nc', "x|y"), "2": (None, None), "3": (None, None)}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_csv(df, str(tmp_path / "o"), ["id"])
    sinks.write_csv(df, str(tmp_path / "o"), ["text", "id"], force=True)


def test_terms(spark, tmp_path):
    (tmp_path / "umls_T1.csv").write_text("cui,tui\nC1,T1\n")
    (tmp_path / "umls_T2.csv").write_text("cui,tui\nC2,T2\n")
    assert {r["cui"] for r in files.read_terms(spark, str(tmp_path)).collect()} == {"C1", "C2"}
    (tmp_path / "umls_terms.csv").write_text("cui,tui\nC9,T9\n")
    assert {r["cui"] for r in files.read_terms(spark, str(tmp_path)).collect()} == {"C9"}
    t = spark.createDataFrame([(f"t{i}", f"T{i % 2}", 1) for i in range(20)], "term_norm string, tui string, priority int")
    assert sinks.write_terms(t, str(tmp_path / "t"), 2) == 20
    with pytest.raises(ValueError):
        sinks.write_terms(t.filter("tui = 'T1'"), str(tmp_path / "t1"), 2)


def test_piped(spark, tmp_path):
    (tmp_path / "m.rrf").write_text("C1|a|C2|\nC3||\n")
    want = [("C1", "a", "C2"), ("C3", "", "")]
    assert [tuple(r) for r in files.read_piped(spark, str(tmp_path / "m.rrf"), ["x", "y", "z"]).collect()] == want
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("2024/META/MRREL.RRF", "C1|a|C2|\nC3||\n")
    got = files.read_zipped(spark, str(tmp_path / "u.zip"), "META/MRREL.RRF", ["x", "y", "z"], batch=1)
    assert sorted(map(tuple, got.collect())) == want


def test_filtered_terms(spark):
    c = spark.createDataFrame([("C1", "ENG", "MSH", "PT", "Fever", "N"), ("C1", "SPA", "MSH", "PT", "Fiebre", "N"), ("C2", "ENG", "XX", "PT", "b", "N"), ("C1", "ENG", "MSH", "SY", "old", "O")], "CUI string, LAT string, SAB string, TTY string, STR string, SUPPRESS string")
    t = spark.createDataFrame([("C1", "T1"), ("C1", "T1"), ("C2", "T2")], "CUI string, TUI string")
    assert [(r["term_norm"], r["tui"]) for r in files.filtered_terms(c, t, ["T1"], "MSH").collect()] == [("fever", "T1")]


def test_pasted(spark):
    r = files.pasted(spark, "abc").first()
    assert r["case_id"] == "pasted-ba7816bf8f01cfea"


def test_graph_files(spark, tmp_path):
    n = spark.createDataFrame([("c", "b", "B"), ("c", "a", "A"), ("d", "x", "X")], "case_id string, node string, label string")
    e = spark.createDataFrame([("c", "a", "b", "R", 2)], "case_id string, source string, target string, relation string, n int")
    g = {r["case_id"]: r["graph"] for r in sinks.graph_json(n, e).collect()}
    again = {r["case_id"]: r["graph"] for r in sinks.graph_json(n.orderBy("node"), e).collect()}
    assert g == again
    c = json.loads(g["c"])
    assert [x["node"] for x in c["nodes"]] == ["a", "b"] and json.loads(g["d"])["edges"] == []
    assert sinks.graphml(c) == sinks.graphml(c) and b'<edge id="e0" source="a" target="b">' in sinks.graphml(c)
    z = zipfile.ZipFile(io.BytesIO(sinks.zipped_csv(c)))
    assert z.read("edges.csv") == b"source,target,relation,n\na,b,R,2\n" and sinks.zipped_csv(c) == sinks.zipped_csv(c)
    sinks.save(b"x", str(tmp_path / "g"))
    with pytest.raises(FileExistsError):
        sinks.save(b"x", str(tmp_path / "g"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "x y"), ("b", "z")], "id string, text string").write.parquet(str(tmp_path / "in"))
    s = incremental.new_files(spark, str(tmp_path / "in"), "id string, text string")
    q = incremental.apply(s, lambda df: lexicon.windows(df, "id", "text", 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
