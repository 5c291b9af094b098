"""Spark session settings shared by the library, tests and the benchmark.

The library never creates a session on its own inside an operator; callers pass
one in.  ``get_spark`` is a convenience for tests, ``bench.py`` and notebooks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this package relies on:
#  * UTC session zone: dates and the hockey-date rule are computed explicitly.
#  * ANSI mode: invalid casts raise, so every lenient parse uses try_* on purpose.
#  * AQE: a join planned as a shuffle becomes a broadcast only when the measured
#    shuffle output is under the adaptive threshold; skewed partitions are split.
#    (Spark's own static threshold, 10 MB of estimated size, applies before that.)
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A task sorts the rows of its merged partitions several times over; packed rows of a
    # few columns take ten times their shuffled size there.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot game or player may hold a large share of the rows: let AQE split
    # such a join partition even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "puckline", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    local = (master or "local").startswith("local")
    if shuffle_partitions or local:  # a cluster's own default otherwise
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    builder = builder.config("spark.driver.memory", os.environ.get("PUCKLINE_DRIVER_MEMORY", "16g"))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of BASE_CONF to an existing session."""
    for key, value in BASE_CONF.items():
        if key == "spark.ui.enabled":
            continue
        try:
            spark.conf.set(key, value)
        except Exception:  # static conf on an already running session
            pass


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is.  Only when it is unset on a local master (tests) a new scratch folder
    is created and registered, so that ``DataFrame.checkpoint`` works as well;
    on a cluster an unset folder is an error, as executors share no disk.
    """
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir())
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="puckline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(base)
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # some sessions refuse runtime changes of core settings
            pass
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and continue from the files
    (``DataFrame.checkpoint``): used for small intermediates that several
    branches of one plan read, and to cut long lineages."""
    spark = df.sparkSession
    shared_dir(spark, "ckpt")  # makes sure a checkpoint folder is registered
    cp = df.checkpoint(eager=True)
    # The checkpoint keeps the source's attribute ids; re-alias the columns so
    # a later join with another branch of the same source cannot see
    # conflicting references.
    return cp.toDF(*cp.columns)
