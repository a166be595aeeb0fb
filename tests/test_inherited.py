"""Inherited orphans over every foreign key of the delivered tables, row by row."""

import datetime as dt

import __spark_entry__ as entry


def at(month, day=1):
    return dt.datetime(2024, month, day)


TABLES = {
    "gazetteer": ("cui string, added_at timestamp, retired_at timestamp", [("C1", at(1), None)]),
    "metadata": ("article_id string, loaded_at timestamp, withdrawn_at timestamp", [("A1", at(1), None), ("A2", at(1), at(2))]),
    "cases_clean": ("case_id string, article_id string, loaded_at timestamp", [("K1", " a1", at(3)), ("K2", "A2", at(3)), ("K2", "A1", at(4)), ("K3", "A9", at(4))]),
    "relations": ("rel_id bigint, case_id string, head_cui string, extracted_at timestamp", [(1, "K1", "C1", at(5)), (2, "K2", "c1", at(5)), (3, "K3", "C9", at(6)), (4, "K1", "C9", at(6))]),
    "umls_relations": ("edge_id bigint, head_cui string, tail_cui string, loaded_at timestamp", [(1, "C8", "C9", at(2)), (2, "C1", "", at(2))]),
    "trechos": ("trecho_id bigint, case_id string, recorded_at timestamp", [(1, "K1", at(7)), (2, "K2", at(7)), (2, "K2", at(8)), (3, None, at(7)), (4, "K3", at(9))]),
}


def test_every_key_and_period(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["p4_inherited"](spark, str(tmp_path)).collect())
    assert got == [
        ("cases_clean", "2024-03", "K2", 0), ("cases_clean", "2024-04", "K3", 0),
        ("relations", "2024-05", "2", 1), ("relations", "2024-06", "3", 0), ("relations", "2024-06", "4", 0),
        ("trechos", "2024-07", "2", 1), ("trechos", "2024-09", "4", 1), ("umls_relations", "2024-02", "1", 0),
    ]
    assert got == sorted(con.sql(entry.oracle_sql()["p4_inherited"]).fetchall())
