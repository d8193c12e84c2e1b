"""The Spark session that the API and the command line start when none is running."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: What the engine asks of a session; adaptive execution picks joins, partition sizes and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None) -> SparkSession:
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = SparkSession.builder.appName("quillion").config(map=SETTINGS).config("spark.ui.showConsoleProgress", "false")
    if master or "SPARK_MASTER" in os.environ or "MASTER" in os.environ:
        builder = builder.master(master or os.environ.get("SPARK_MASTER") or os.environ["MASTER"])
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the driver and all executors share; a temporary folder where that is unset on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quillion-")
