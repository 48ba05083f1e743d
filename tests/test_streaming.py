from __future__ import annotations

from stratalog.store import Store
from stratalog.streaming.ingest import current_values, ingest


def test_ingest_commits_each_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "key binary, value binary, kind int"
    with Store.open(spark, str(tmp_path / "db")) as store:
        for batch in ([("a", "1", 1), ("b", "2", 1)], [("a", None, 3), ("c", "3", 1)]):
            spark.createDataFrame([(bytearray(k.encode()), v and bytearray(v.encode()), n) for k, v, n in batch], schema).coalesce(1).write.mode("append").parquet(src)
            ingest(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "state")).awaitTermination()
        assert [(bytes(r["key"]), bytes(r["value"])) for r in store.scan().collect()] == [(b"b", b"2"), (b"c", b"3")]
        assert store.stats().seq == 2


def test_current_values_ignore_older_versions(spark, tmp_path):
    src = str(tmp_path / "log")
    rows = [("a", 1, 1, "x"), ("a", 5, 1, "y"), ("b", 2, 3, None)]
    spark.createDataFrame(rows, "key string, seq long, kind int, value string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key string, seq long, kind int, value string").parquet(src)
    q = current_values(stream).writeStream.format("memory").queryName("current").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("current").collect()) == [("a", 5, False, "y"), ("b", 2, True, None)]


def test_a_batch_keeps_the_last_row_of_a_key(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "key binary, value binary, kind int, at int"
    with Store.open(spark, str(tmp_path / "db")) as store:
        rows = [(bytearray(b"a"), v and bytearray(v), k, at) for v, k, at in ((b"9", 1, 0), (None, 3, 1), (b"1", 1, 2))]
        spark.createDataFrame(rows, schema).write.parquet(src)
        for _ in range(2):  # a second run has nothing new
            ingest(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "state"), order="at").awaitTermination()
        assert store.get(b"a") == b"1" and store.stats().seq == 1
