"""Published pairs against new counts: gone, new and standing pairs all come out."""

import datetime as dt

import __spark_entry__ as entry


def test_gone_and_new_pairs(spark, tmp_path):
    import duckdb

    day = dt.datetime(2024, 1, 1)
    texts = [(1, "Dor febre", day), (2, "febre, dor dor", day), (3, "tosse febre", day), (3, "tosse febre", day), (4, None, day)]
    old = [("Febre ", "dor", 7), ("dor", "febre", 3), ("gripe", "dor", 41), ("TOSSE", "febre", None)]
    spark.createDataFrame(texts, "trecho_id bigint, texto string, recorded_at timestamp").write.parquet(f"{tmp_path}/trechos.parquet")
    spark.createDataFrame(old, "palavra_1 string, palavra_2 string, contagem bigint").write.parquet(f"{tmp_path}/tabela_pmi.parquet")
    con = duckdb.connect()
    for name in ("trechos", "tabela_pmi"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = [("dor", "febre", 2, 7, True), ("dor", "gripe", 0, 41, True), ("febre", "tosse", 1, None, True)]
    got = lambda: sorted(tuple(r) for r in entry.queries()["p1_compared"](spark, str(tmp_path)).collect())
    assert got() == want == sorted(con.sql(entry.oracle_sql()["p1_compared"]).fetchall())
    spark.createDataFrame(old[2:], "palavra_1 string, palavra_2 string, contagem bigint").write.mode("overwrite").parquet(f"{tmp_path}/tabela_pmi.parquet")
    spark.catalog.clearCache()
    assert got() == [("dor", "febre", 2, None, False), *want[1:]]
