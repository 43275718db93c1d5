"""Shared pieces of the operators: table access, spreading of small inputs, text maps over Arrow batches."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import shared_dir, stored

__all__ = ["map_rows", "shared_dir", "spread", "stored", "table", "texts", "uncollected", "values_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over the cores if the scan has fewer partitions than cores.

    That holds only for inputs below cores x spark.sql.files.maxPartitionBytes, so the shuffle is bounded;
    larger inputs keep the partitions of their scan and move no text.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """src_table, row_id, text of the named tables; rows with a null text are left out."""
    keys = {"documents": ("doc_id", "text"), "units": ("unit_id", "t"), "translations": ("tr_id", "t")}
    out = None
    for n in names:
        k, c = keys[n]
        one = table(spark, sf_dir, n).select(F.lit(n).alias("src_table"), F.col(k).alias("row_id"), F.col(c).alias("text")).where(F.col("text").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles, for work that makes very many objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def values_of(column: pa.Array) -> list:
    """The values of a column of strings, numbers or lists of numbers (of lists none null), as to_pylist(), without an object of Arrow for each."""
    if not pa.types.is_list(column.type):
        return column.to_pylist() if pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()
    flat = column.values.to_numpy().tolist()
    return [flat[a:b] for a, b in pairwise(column.offsets.to_numpy().tolist())]


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Arrow batches through the function that make() builds once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield f(b)

    return df.mapInArrow(run, schema)
