"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a local session gets a temporary folder; a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _of_local_session(spark.sparkContext.applicationId)


@lru_cache(1)
def _of_local_session(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tideline-")
