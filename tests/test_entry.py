"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import glob
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_core_stands_alone():
    """The rest of the library doesn't need the subpackage of the training-data operators."""
    code = "import sys; sys.modules['vellum.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80; assert not [q for q in e.queries() if q.startswith('p1_')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["p4_found", "p4_cascade", "c2_merged", "g5_best", "x1_tokens", "o5_type_prior", "h6_edges", "h10_faults", "h17_compared", "n2_association", "f2_structural", "v3_sweep", "v8_bootstrap", "a8_demographics"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
