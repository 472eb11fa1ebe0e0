"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Settings the operators count on: adaptive joins that split skewed keys and
# pick a broadcast only from measured sizes, and UTC for every timestamp text.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Scored statements share the cores instead of queueing behind one another.
    "spark.scheduler.mode": "FAIR",
    # A statement that is stopped but does not react loses its executor, not its cores for good.
    "spark.task.reaper.enabled": "true",
    "spark.task.reaper.killTimeout": "120s",
}


def build_session(app: str = "evalspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Set the one runtime setting that changes values: the session time zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    A session that runs in one process (tests) may leave it unset and gets a
    folder that goes away with the process; on a cluster executors could not
    read such a folder, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"evalspark-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table in the shared folder."""
    return f"{shared_folder(spark)}/evalspark/{name}-{uuid.uuid4().hex}"
