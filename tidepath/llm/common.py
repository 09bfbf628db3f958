"""Shared plumbing of this subpackage: staged tables, names and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..staging import drop_stage, shared_dir, stage, stage_path

__all__ = ["drop_stage", "free_name", "shared_dir", "stage", "stage_path", "table"]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
