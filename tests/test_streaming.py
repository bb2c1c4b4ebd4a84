from pyspark.sql import functions as F

from rowquarry.streaming import store_stream, stored_batches


def test_every_batch_is_a_table(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    assert stored_batches(spark, path) == []
    for k in range(3):
        spark.range(k * 10, k * 10 + 10, 1, 1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second start finds nothing new
        query = store_stream(stream.withColumn("double", F.col("id") * 2), path, f"{tmp_path}/cp", {"availableNow": True}, sort_by=["id"])
        assert query.awaitTermination(120) and query.exception() is None
        batches = stored_batches(spark, path)
        assert [b.nrow for b in batches] == [10, 10, 10] and batches[0].meta.keys == ["id"]
        assert sorted(r.double for b in batches for r in b.df().collect()) == list(range(0, 60, 2))
