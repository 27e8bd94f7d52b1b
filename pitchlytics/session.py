"""Spark session settings shared by the bench and the tests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def _scratch() -> str:
    """A folder for this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="pitchlytics-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def local_session(app: str = "pitchlytics", cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session; a cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("CHECKPOINT_DIR") or _scratch())
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
