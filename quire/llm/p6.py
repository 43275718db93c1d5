"""Problem 6: one consistent character form for all texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, spread, texts
from .lookalikes import Rewriter, build, counted


def _count() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = counted(x for x in batch.column(0).to_pylist() if x)
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["s", "n"])

    return run


def look_alike_classes(df: DataFrame) -> dict[str, list[str]]:
    """Representative -> other members, from the character counts of all of df.text.

    The counts come to the driver: one row per code point or letter with marks in use, a size bounded
    by the character set and not by the number of texts.
    """
    rows = map_rows(df.select("text"), _count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    return build({r.s: r.n for r in rows.collect()})


def consistent(df: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """df(src_table, row_id, text) with the rewritten text and whether it changed: src_table, row_id, text, changed.

    A narrow map. Null texts stay null and blank texts stay as they are; neither counts as changed.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        rewriter = Rewriter(classes)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            old = batch.column(2).to_pylist()
            new = [rewriter.rewrite(x) if x and not x.isspace() else x for x in old]
            changed = [a is not b and a != b for a, b in zip(old, new, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string()), pa.array(changed, pa.bool_())], ["src_table", "row_id", "text", "changed"])

        return run

    return map_rows(df.select("src_table", "row_id", "text"), make, "src_table string, row_id bigint, text string, changed boolean")


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(texts(spark, sf_dir, "documents", "translations"))
    return consistent(rows, look_alike_classes(rows))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_consistent(spark, sf_dir).where("changed").select("src_table", "row_id")
