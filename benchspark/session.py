"""Session defaults and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "benchspark", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew splitting on; anything else is the cluster's choice."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join partition even where the split costs one more shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # small inputs keep their parallelism; on large ones the advisory partition size decides
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``; where that is unset, a local one in local mode only.

    Executors of a cluster would each write to a disk of their own, so a cluster without the setting is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="benchspark-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex[:12]}")
