"""Tables written to the cluster's shared folder to end a lineage: loops read them back, a lost executor costs one round."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_known: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a temporary one serves a local master (tests); a cluster has no such folder that all machines see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidepath-")
    return _own[app]


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no DataFrame reads any more."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder is then the cluster's to clean
        pass


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; all paths of this application go when Python ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/tidepath-{app}"
    if app not in _known:
        _known.add(app)
        atexit.register(drop_stage, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
