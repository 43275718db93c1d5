"""Tables between steps, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    base = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, base, True)
    return "file://" + base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared spark.checkpoint.dir.

    Where that is unset, a local session, as in tests, gets a folder of its own that goes with the process; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """The table written out and read again: what follows neither plans nor computes again what led to it, even if executors are lost."""
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)
