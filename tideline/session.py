"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where a later step could have reused the join's partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # whole texts go to Python: small batches bound a worker's memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
SETTINGS = {
    **RUNTIME,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tideline", **extra: str) -> SparkSession:
    """A session with the settings the operators assume; master comes from the environment."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings the joins rely on, in a session made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where a session on one machine names none, the warehouse folder is taken; a cluster has to name it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/tideline-scratch"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tideline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A new path in the application's own folder below the shared one."""
    folder = _application_dir(spark)
    if folder not in _CLEANED:
        _CLEANED.add(folder)
        atexit.register(_at_exit, spark)
    return f"{folder}/{uuid.uuid4().hex}"


_CLEANED: set[str] = set()


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has written by :func:`durable`.

    Results that are not yet written elsewhere may still read them, so call it when these are done. It
    runs by itself when Python ends in order.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped already
        clean(spark)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, its lineage cut.

    Used where a result feeds two passes that must see identical floats, or an iteration: a
    recomputed partition may sum doubles in another order, a written one cannot. Unlike a cached or
    checkpointed plan, the written table has a known size, so joins on it are planned by size.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
