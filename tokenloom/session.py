"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tokenloom", extra: dict | None = None) -> SparkSession:
    """A session with the settings every tokenloom job expects.

    AQE stays on: it coalesces small shuffle partitions, splits skewed join partitions and broadcasts a side once it has
    measured it. The static threshold is off: an estimate from compressed file sizes is no size check.
    """
    cpus = os.cpu_count() or 8
    master = master or f"local[{cpus}]"
    b = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(10 << 20))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 2 * cpus))
        .config("spark.driver.memory", os.environ.get("TOKENLOOM_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and spill-to-table steps.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file
    system); it is only set here when the session has none, as in local tests.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d.removeprefix("file:")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="tokenloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return d


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df, name: str = "stage"):
    """Write ``df`` once to the shared checkpoint folder and read it back (a lineage cut).

    Later branches of the plan read the written table instead of recomputing the
    input, and a lost executor re-reads files instead of re-running upstream work.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
