"""Readers for the Parquet tables and the session settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quire", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; a running session is returned as it is."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
