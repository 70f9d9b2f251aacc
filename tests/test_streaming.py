"""Streams over stored logs give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewell import streaming
from brinewell.operators import control, runs, versions
from brinewell.sources import kv_ops, store


def _stored(spark, sf_dir, path):
    ops = kv_ops(spark, sf_dir)
    for i in range(3):
        ops.where(f"seq between {i * 3334} and {i * 3334 + 3333}").coalesce(1).write.mode("append").parquet(path)
    return ops


def test_flushed_stream_equals_snapshot(spark, sf_dir, tmp_path):
    ops = _stored(spark, sf_dir, str(tmp_path / "log"))
    root, checkpoint = str(tmp_path / "runs"), str(tmp_path / "cp")
    for _ in range(2):  # the second finds nothing new
        streaming.flush_stream(streaming.read_log(spark, str(tmp_path / "log")), root, checkpoint).awaitTermination()
    found = store.runs(spark, root)
    assert {r.gen for r in found.select("gen").distinct().collect()} == {0, 1, 2}
    best = found.groupBy("key").agg(F.max_by(F.struct("value", "tombstone"), "seq").alias("x")).where("not x.tombstone").select("key", "x.value")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, versions.snapshot(ops).select("key", "value").collect()))
    assert runs.run_bounds(found).count() == 3


def test_limited_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("seq"), (F.col("id") * 40).alias("at"), F.lit(1).alias("n"))
    for i in range(2):
        rows.where(f"seq between {i * 200} and {i * 200 + 199}").coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    stream = streaming.read_log(spark, str(tmp_path / "r"), 2, "key string, seq bigint, at bigint, n int")
    q = streaming.limit_stream(stream, 3, 700).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("limited").select("key", "seq", "allowed").collect()))
    assert got == sorted(map(tuple, control.bucket_decisions(rows, 3, 700).collect()))


def test_windowed_counts(spark, sf_dir, tmp_path):
    ops = _stored(spark, sf_dir, str(tmp_path / "log"))
    stream = streaming.windowed_counts(streaming.read_log(spark, str(tmp_path / "log"), 3), "1 day", "1 hour")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.ops for r in spark.table("counts").collect()) == ops.count()
