"""Weekly patterns of profiles and the evidence they give, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of pattern classes and calibration postures.
STRONG_RANGE, WEAK_RANGE, BASELINE_DISTANCE = 0.20, 0.05, 0.10
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.80, 0.55


def _f(x: Column) -> Column:
    return x.cast("float")


def posture(pattern: Column, confidence: Column) -> Column:
    """How far a profile's recurring signal is to be trusted: by its pattern first, then by its confidence."""
    by_confidence = F.when(confidence >= HIGH_CONFIDENCE, "HIGH_CONFIDENCE").when(confidence >= MEDIUM_CONFIDENCE, "MEDIUM_CONFIDENCE").otherwise("LOW_CONFIDENCE")
    return F.when(pattern == "FULLY_PERSISTENT", "NO_RECURRING_SIGNAL").when(pattern == "WEAK_SIGNAL_PERIODIC", "WEAK_SIGNAL_REJECTED").otherwise(by_confidence)


def profile_stats(profiles: DataFrame) -> DataFrame:
    """profiles with avg_multiplier (summed in double), min_multiplier and max_multiplier."""
    mean = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + b.cast("double")) / F.size("buckets")
    return profiles.withColumns({"avg_multiplier": _f(mean), "min_multiplier": F.array_min("buckets"), "max_multiplier": F.array_max("buckets")})


def profile_patterns(profiles: DataFrame) -> DataFrame:
    """profile_stats plus active_days, weekly_mean, weekly_min, weekly_max, weekly_range, pattern, support_windows, confidence, posture, flavor."""
    one = F.lit(1.0).cast("float")
    days = F.bit_count(F.col("day_mask").bitwiseAND(127))
    all_days = F.col("active_days") == 7
    df = profile_stats(profiles).withColumn("active_days", days.cast("int"))
    df = df.withColumns({
        "weekly_mean": _f((F.col("avg_multiplier").cast("double") * F.col("active_days") + (7 - F.col("active_days"))) / 7.0),
        "weekly_min": F.when(all_days, F.col("min_multiplier")).otherwise(F.least("min_multiplier", one)),
        "weekly_max": F.when(all_days, F.col("max_multiplier")).otherwise(F.greatest("max_multiplier", one)),
    })
    df = df.withColumn("weekly_range", _f((F.col("weekly_max").cast("double") - F.col("weekly_min").cast("double")) / F.greatest(F.lit(1.0), F.col("weekly_mean").cast("double"))))
    off = (F.col("weekly_min") >= 1 + BASELINE_DISTANCE) | (F.col("weekly_max") <= 1 - BASELINE_DISTANCE)
    df = df.withColumn("pattern", F.when((F.col("weekly_range") >= STRONG_RANGE) & off, "MIXED_PERSISTENT_AND_PERIODIC").when(F.col("weekly_range") >= STRONG_RANGE, "STRICT_PERIODIC").when(F.col("weekly_range") >= WEAK_RANGE, "WEAK_SIGNAL_PERIODIC").otherwise("FULLY_PERSISTENT"))
    least = F.greatest(F.lit(0.02), F.col("avg_multiplier").cast("double") * 0.05)
    deviating = F.size(F.filter("buckets", lambda b: F.abs(b.cast("double") - F.col("avg_multiplier").cast("double")) >= least))
    df = df.withColumn("support_windows", F.when(F.col("weekly_range") < WEAK_RANGE, F.lit(0)).otherwise(F.greatest(F.lit(1), deviating) * F.greatest(F.lit(1), F.col("active_days"))))
    periodic = F.col("pattern").isin("STRICT_PERIODIC", "MIXED_PERSISTENT_AND_PERIODIC")
    score = 0.45 * F.least(F.lit(1.0), F.col("weekly_range").cast("double") / STRONG_RANGE) + 0.25 * F.least(F.lit(1.0), F.col("active_days") / 7.0) + 0.30 * F.least(F.lit(1.0), F.col("support_windows") / 14.0)
    df = df.withColumn("confidence", _f(F.when(periodic, F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))))
    return df.withColumn("posture", posture(F.col("pattern"), F.col("confidence"))).withColumn("flavor", F.when(periodic, "ROUTINE_PERIODIC").otherwise("NONE"))
