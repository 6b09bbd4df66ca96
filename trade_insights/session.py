"""Session and checkpoint-folder helpers.

Library code never creates a session; it takes the caller's. ``local_session``
exists for tests and the benchmark only.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "trade_insights") -> SparkSession:
    """A local session configured the way the tests and bench.py run."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRADE_INSIGHTS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # Group keys an object-hash aggregate (the per-group value lists of
        # concatenated-distinct columns) keeps before falling back to sorting.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder the cluster names for checkpoints.

    On a cluster ``spark.checkpoint.dir`` (or ``SparkContext.setCheckpointDir``)
    names a folder every executor can reach; we use it as is. Where it is
    unset, a local master gets a private folder, and any other raises, since
    its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="trade_insights-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def work_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name
