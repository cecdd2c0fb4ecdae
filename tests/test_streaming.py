"""The live twins on files of micro-batches."""

from pyspark.sql import functions as F

from orebody.operators import sketches
from orebody.streaming import live


def drain(frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def feed(spark, path):
    rows = [(i + 1, f"2020-01-01 {i // 60:02d}:{i % 60:02d}:00", str(i % 7), "k") for i in range(180)]
    df = spark.createDataFrame(rows, "seq long, ts string, user_id string, key string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        df.where(f"seq > {60 * i} AND seq <= {60 * i + 60}").coalesce(1).write.mode("append").parquet(path)
    return live.read_events(spark, path, "seq long, ts timestamp, user_id string, key string")


def test_windows_first_seen_and_reservoirs(spark, tmp_path):
    events = feed(spark, str(tmp_path / "in"))
    drain(live.windowed_counts(events), "windows", "append")
    assert spark.table("windows").agg(F.sum("n")).first()[0] in (60, 120, 180)
    drain(live.first_seen(events), "firsts", "complete")
    assert spark.table("firsts").count() == 7
    drain(live.reservoirs(events, k=5), "samples", "update")
    last = spark.table("samples").orderBy(F.col("n").desc()).first()
    assert last["n"] == 180 and len(last["sample"].split(",")) == 5


def test_batch_operator_on_micro_batches(spark, tmp_path):
    events = feed(spark, str(tmp_path / "in"))
    got = []
    q = live.by_batch(events, lambda df, i: got.append(sketches.batch_sizes(df.select("seq", "user_id"), 60).count()), str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(got) == 3
