"""Retention of results: a table of payloads with an end, a size and a last read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULTS = "result_id string, topology_version string, created_at long, expires_at long, last_read long, bytes long, payload string"


def as_result(rows: DataFrame, key: str, version: Column, now: int, ttl: int) -> DataFrame:
    """One result per key, its rows as JSON in a canonical order; size is the payload's."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))))
    packed = rows.groupBy(F.col(key).cast("string").alias("result_id")).agg(body.alias("payload"))
    now_col = F.lit(now).cast("long")
    return packed.select("result_id", version.alias("topology_version"), now_col.alias("created_at"), (now_col + ttl).alias("expires_at"), now_col.alias("last_read"), F.octet_length("payload").cast("long").alias("bytes"), "payload")


def check_results(results: DataFrame) -> DataFrame:
    """result_id, reason_code of rows that may not be stored."""
    reason = F.when(F.col("result_id").isNull() | (F.trim("result_id") == ""), "RESULT_ID_REQUIRED").when(F.col("expires_at").isNull() | (F.col("expires_at") <= F.col("created_at")), "RESULT_EXPIRY").when(F.col("payload").isNull(), "RESULT_PAYLOAD_REQUIRED")
    return results.withColumn("reason_code", reason).filter("reason_code is not null").select("result_id", "reason_code")


def purge(results: DataFrame, now: int) -> DataFrame:
    return results.filter(F.col("expires_at") > now)


def within_budget(results: DataFrame, budget: int) -> DataFrame:
    """The results that stay: victims are those that end first, then those read least recently, until the rest fits.

    A running sum from the last victim on, in two levels: sums per end of life first, so no task orders all
    results; only the results of the one end that the cut falls in are ordered among themselves.
    """
    per = results.groupBy("expires_at").agg(F.sum("bytes").alias("b"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("expires_at")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("above", F.coalesce(F.sum("b").over(above), F.lit(0)))
    inside = Window.partitionBy("expires_at").orderBy(F.desc("last_read"), "result_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.join(per.filter(F.col("above") < budget).select("expires_at", "above"), "expires_at").withColumn("used", F.col("above") + F.sum("bytes").over(inside))
    return rows.filter(F.col("used") <= budget).select(*results.columns)


def put(store: DataFrame, new: DataFrame, now: int, budget: int) -> DataFrame:
    """The store after new results replace those of the same id, expired ones are purged and the budget is kept."""
    fresh = new.join(check_results(new), "result_id", "left_anti").filter(F.col("bytes") <= budget)
    merged = purge(store, now).join(fresh.select("result_id"), "result_id", "left_anti").select(*new.columns).unionByName(fresh.select(*new.columns))
    return within_budget(merged, budget)


def get(store: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Stored results of the ids that have not expired."""
    return purge(store, now).join(ids.select("result_id"), "result_id", "left_semi")


def touch(store: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    read = ids.select("result_id", F.lit(now).cast("long").alias("_now"))
    return store.join(read, "result_id", "left").withColumn("last_read", F.coalesce("_now", "last_read")).drop("_now")


def invalidate(store: DataFrame, rule: Column) -> DataFrame:
    return store.filter(~F.coalesce(rule, F.lit(False)))


def after_reload(store: DataFrame, version: str, policy: str) -> DataFrame:
    """RETAIN_UNTIL_EXPIRY keeps all, INVALIDATE_STALE only results of the version."""
    return store if policy == "RETAIN_UNTIL_EXPIRY" else invalidate(store, F.col("topology_version") != version)
