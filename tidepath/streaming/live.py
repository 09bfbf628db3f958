"""Live overlay and quarantine as streams: batches of events become versions of a small keyed table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import overlay as live
from ..operators import topology


class LiveTable:
    """A table whose versions are folders; a batch reads the last one and writes the next, so a repeated batch gives the same version."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at)]
        return sorted(int(p.getName()[1:]) for p in done if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{known[-1]:012d}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v{version:012d}")


def overlay_stream(updates: DataFrame, table: LiveTable, checkpoint: str, capacity: int | None = None, policy: str = "EVICT_OLDEST_EXPIRY", rejects: LiveTable | None = None) -> StreamingQuery:
    """Merge a stream of updates (edge_idx, speed_factor, valid_from, valid_until, ordinal, now) batch by batch; late ones, expired at their batch's latest `now`, are left out and, like invalid ones, go to rejects.

    The cap spans keys, which keyed state cannot see, so each batch merges whole tables.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        now = batch.agg(F.max("now")).first()[0]
        current = table.read(before=number)
        if now is None:
            table.write(current, number)
        else:
            plain = batch.drop("now")
            done = live.merge(current, plain, now) if capacity is None else live.merge_capped(current, plain, now, capacity, policy)
            table.write(done.select(*live.SLOTS), number)
            if rejects is not None:
                judged = live.checked(plain).withColumn("reason_code", F.coalesce("reason_code", F.when(F.col("valid_until") <= now, "OVERLAY_EXPIRED")))
                rejects.write(judged.filter("reason_code is not null").select("edge_idx", "ordinal", "reason_code"), number)
        batch.unpersist()

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).queryName(f"overlay-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()


def quarantine_stream(events: DataFrame, table: LiveTable, checkpoint: str) -> StreamingQuery:
    """Keep the last failure of each subject from a stream of quarantine rows."""

    def merge(batch: DataFrame, number: int) -> None:
        both = table.read(before=number).unionByName(batch.select("kind", "subject_idx", "valid_until", "observed_at", "reason", "source"))
        table.write(topology.last_failures(both).select("kind", "subject_idx", "valid_until", "observed_at", "reason", "source"), number)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).queryName(f"quarantine-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()


def congestion(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and mean values of events per type and tumbling window, with a watermark: the input of profiles."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")
