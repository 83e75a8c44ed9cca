"""Session factory with the settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use underscores for dots."""
    builder = SparkSession.builder.appName("veduta").config(map=SETTINGS | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the one that driver and executors share (``spark.checkpoint.dir``); where that is
    unset a temporary one in local mode, and an error on a cluster."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veduta-checkpoint-"))
        shared = context.getCheckpointDir()
    return f"{shared}/{name}-{uuid.uuid4().hex}"
