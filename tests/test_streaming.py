"""The same operators over a stream and over a table."""

from pyspark.sql import functions as F

from wayfind.streaming import events as streams

SF = "/root/testdata/sf0.001"


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    return table, spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))


def test_windows(spark, tmp_path):
    table, stream = source(spark, tmp_path)
    got = drain(streams.counts_by_window(stream), "win", "complete", tmp_path)
    want = streams.counts_by_window(table)
    assert got.select("start", "event_type", "n").exceptAll(want.select("start", "event_type", "n")).isEmpty() and got.count() == want.count()


def test_rationed(spark, tmp_path):
    _, stream = source(spark, tmp_path)
    calls = stream.select(F.col("user_id").alias("caller"), F.col("event_id").alias("call_id"), F.col("ts").alias("at"))
    got = drain(streams.rationed(calls, 2, 5), "rationed", "append", tmp_path)
    from wayfind.operators.accounts import rationed

    table = spark.read.parquet(str(tmp_path / "in")).select(F.col("event_id").alias("call_id"), F.col("user_id").alias("caller"), F.col("ts").alias("at"))
    want = rationed(table, 2, 5)
    assert got.select("call_id", "admitted").exceptAll(want).isEmpty() and got.count() == want.count()
