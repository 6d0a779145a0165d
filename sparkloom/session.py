"""The session that tests and the bench share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Where both sides of a union are hash-partitioned alike, Spark 4.1 takes the union for so partitioned as well,
#: and then coalesces the sides apart: an aggregate above it finds its groups in pieces.
UNION_SETTING = "spark.sql.unionOutputPartitioning"


def safe_unions(spark: SparkSession) -> None:
    """Make aggregates over unions (and ``exceptAll``, which is one) shuffle for themselves."""
    if spark.conf.get(UNION_SETTING, "true") != "false":
        spark.conf.set(UNION_SETTING, "false")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of ``spark.checkpoint.dir``; a session of one machine without one gets a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {sc.master} share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loom-"))
    return df.checkpoint()


def get_session(cpus: int | str | None = None, app: str = "sparkloom") -> SparkSession:
    """A local session with the settings the library expects; on a cluster use its own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config(UNION_SETTING, "false")
        .config("spark.driver.memory", os.environ.get("LOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
