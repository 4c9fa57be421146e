"""A folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new name below ``spark.checkpoint.dir``; where that is unset, below the context's checkpoint directory or, with a local master only, a folder of this machine. Raises ValueError on a cluster without either."""
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            root = tempfile.mkdtemp(prefix="sparktrend-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
