"""A folder that driver and executors share, for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path below the one that the session names in spark.checkpoint.dir.

    Without one, a temporary folder does in local mode; a cluster's executors could not read it, so there it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tablemill-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/tablemill-{uuid.uuid4().hex}"
