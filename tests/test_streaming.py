"""The stream gives the rows of the batch."""

import shutil

from pyspark.sql import functions as F

from tessera.streaming import events


def test_stream_equals_batch(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{folder}/events.parquet", tmp_path / "in/events.parquet")
    stream = events.tumbling(events.stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.tumbling(events.batch(spark.read.parquet(f"{folder}/events.parquet")))
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.agg(F.sum("n")).first()[0] == 1000


def test_stream_drops_repeats_within_the_watermark(spark, folder, tmp_path):
    from tessera.plans.changes import repeated

    source = tmp_path / "in"
    repeated(spark.read.parquet(f"{folder}/events.parquet")).coalesce(1).write.parquet(str(source))
    stream = events.deduplicated(events.stream(spark, str(source)), ["event_id"])
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.event_id for r in spark.table("once").collect()]
    assert len(got) == len(set(got)) == 1000


def test_replayed_batch_leaves_the_same_table(spark, tmp_path):
    from datetime import datetime

    schema = "user_id long, ts timestamp, op string, value double"
    at = lambda h: datetime(2024, 1, 1, h)
    base = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0)], "user_id long, name string, value double")
    batches = [[(1, at(1), "set", 11.0), (4, at(1), "set", 40.0)], [(1, at(0), "set", 12.0), (2, at(2), "delete", None)], [(2, at(1), "set", 21.0), (2, at(3), "set", 22.0), (3, at(1), "delete", None)]]
    path, write = str(tmp_path / "log"), events.batch_log(str(tmp_path / "log"))

    def table(upto):
        log = events.read_log(spark, path, schema).where(F.col("batch") < upto)
        return sorted(map(tuple, events.merged(base, log, ["user_id"], ["ts"], ["value"]).collect()))

    for i, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), i)
    want = [(1, "a", 12.0), (2, "b", 22.0), (4, None, 40.0)]
    assert table(3) == want and table(2) == [(1, "a", 12.0), (3, "c", 30.0), (4, None, 40.0)]
    write(spark.createDataFrame(batches[1], schema), 1)  # the stream restarts and sends its batches again
    write(spark.createDataFrame(batches[2], schema), 2)
    assert table(3) == want


def test_foreach_batch_survives_a_lost_commit(spark, folder, tmp_path):
    source, path, cp = tmp_path / "in", str(tmp_path / "log"), tmp_path / "cp"
    spark.read.parquet(f"{folder}/events.parquet").repartition(3, "event_id").write.parquet(str(source))

    def run():
        stream = events.stream(spark, str(source)).select("user_id", "event_id", "ts", F.lit("set").alias("op"), "value")
        q = stream.writeStream.foreachBatch(events.batch_log(path)).option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    log = lambda: sorted(map(tuple, events.read_log(spark, path, "user_id long, event_id long, ts timestamp, op string, value double").collect()))
    first = log()
    for commit in (cp / "commits").iterdir():  # the batch was written, but its commit was lost
        commit.unlink()
    run()
    assert len(first) == 1000 and log() == first
