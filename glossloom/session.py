"""Session helpers: builder, reliable checkpoints, shared work folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "glossloom", master: str | None = None, **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in spark.checkpoint.dir.

    Where the setting is absent, a local run gets a scratch folder of its own;
    a cluster run must name one.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows over all cores when the scan has fewer partitions than cores; otherwise unchanged.

    For work that is heavy per row on inputs of few files; large inputs keep their
    scan. With `rows`, a task gets about so many rows at most, however large the
    input; this counts the rows, so df should be a plain scan.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
