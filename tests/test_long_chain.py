"""The cascade goes on until a round finds none, however long the chain."""

from vellum.operators.references import Edge, cascade


def test_more_than_fifty_links(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = spark.createDataFrame([(str(i + 1), str(i)) for i in range(53)], "key string, ref string").coalesce(1)
        direct = spark.createDataFrame([("t", "0")], "table_name string, row_key string")
        got = {(r["row_key"], r["depth"]) for r in cascade(direct, [Edge("t", "t", rows)]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {(str(i), i) for i in range(54)}
