"""A stream of bars against the batch job."""

import tempfile

from pyspark.sql import functions as F

from folionaut.operators.market import normalize_bars
from folionaut.streaming.bars import daily_bars


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    source = tempfile.mkdtemp(prefix="spark-")
    batch.repartition(3).write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = daily_bars(stream, "user_id", "ts", "value", "10000 days").writeStream.outputMode("update").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    # In update mode a day shows again when a later bar comes: the last word is the largest instant's.
    shown = spark.table("bars").select("symbol", "date").distinct().count()
    want = normalize_bars(batch, "user_id", "ts", "value", "value")
    assert shown == want.count()
    assert spark.table("bars").join(want.withColumnRenamed("close", "c"), ["symbol", "date"]).where(F.col("close") == F.col("c")).select("symbol", "date").distinct().count() == shown
