import datetime as dt

from tidepath.operators import overlay, topology
from tidepath.streaming import live

SLOTS = "edge_idx int, speed_factor float, valid_from long, valid_until long"
IN = "edge_idx int, speed_factor float, valid_from long, valid_until long, ordinal long, now long"


def test_overlay_stream_equals_batches(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = [(1, 0.5, 0, 100, 0, 10), (2, 0.5, 0, 5, 1, 10), (3, 2.0, 0, 99, 2, 10)]
    second = [(1, 0.0, 0, 200, 3, 20), (4, 0.25, 0, 300, 4, 20)]
    kept, rejects = live.LiveTable(spark, f"{root}/table", SLOTS), live.LiveTable(spark, f"{root}/rejects", "edge_idx int, ordinal long, reason_code string")
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, IN).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(IN).parquet(f"{root}/in")
        live.overlay_stream(source, kept, f"{root}/checkpoint", rejects=rejects).awaitTermination()
        if i == 0:
            assert {r.reason_code for r in rejects.read().collect()} == {"OVERLAY_EXPIRED", "OVERLAY_SPEED_FACTOR"}
    want = overlay.merge(spark.createDataFrame([], SLOTS), spark.createDataFrame(first, IN).drop("now"), 10)
    want = overlay.merge(want, spark.createDataFrame(second, IN).drop("now"), 20)
    assert {tuple(r) for r in kept.read().collect()} == {tuple(r) for r in want.collect()} and kept.read().count() == 2


def test_quarantine_stream(spark, tmp_path):
    root = f"file://{tmp_path}"
    table = live.LiveTable(spark, f"{root}/table", topology.QUARANTINE)
    for rows in ([("edge", 1, 50, 1, "a", "s"), ("node", 1, 60, 1, "b", "s")], [("edge", 1, 20, 2, "c", "s")]):
        spark.createDataFrame(rows, topology.QUARANTINE).coalesce(1).write.mode("append").parquet(f"{root}/in")
        live.quarantine_stream(spark.readStream.schema(topology.QUARANTINE).parquet(f"{root}/in"), table, f"{root}/checkpoint").awaitTermination()
    assert {(r.kind, r.valid_until) for r in table.read().collect()} == {("edge", 20), ("node", 60)}


def test_congestion_windows(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    at = dt.datetime(2024, 1, 1, 10, 5)
    spark.createDataFrame([(at, "view", 1.0), (at, "view", 3.0), (at + dt.timedelta(hours=5), "view", 9.0)], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(path)
    source = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(path)
    q = live.congestion(source).writeStream.outputMode("complete").format("memory").queryName("congestion").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.n, r.mean_value) for r in spark.table("congestion").collect()} == {(2, 2.0), (1, 9.0)}
