"""Session set-up: settings for scale, and this package on the Python workers' path."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Settings a deployment starts from; sizes of partitions are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where PYTHONPATH was not set for them."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only a local master, whose executors are the driver, gets one made where the
    session names none, as in tests.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quern-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Applications whose folder is already marked to go.
_MARKED: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it is deleted when the driver ends."""
    name = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/quern-{name}"
    if path not in _MARKED:
        _MARKED.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def create(app: str = "quern", **settings: str) -> SparkSession:
    """A session with the engine's settings; the master comes from the environment or spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())
