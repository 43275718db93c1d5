"""Problem 1: the sentence units of all texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, spread, texts
from .sentences import segment


def _units() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        for i, text in enumerate(batch.column(2).to_pylist()):
            for s, e in segment(text):
                rows.append(i)
                starts.append(s)
                ends.append(e)
        take = pa.array(rows, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            ["src_table", "row_id", "start_pos", "end_pos"],
        )

    return run


def sentence_units(df: DataFrame) -> DataFrame:
    """One row per sentence unit of df(src_table, row_id, text): src_table, row_id, start_pos, end_pos.

    A narrow map: no shuffle, each text whole in one task. Null, blank and letterless texts give no row;
    repeated rows give their units once each; other columns are ignored.
    """
    rows = df.select("src_table", "row_id", "text")
    return map_rows(rows, _units, "src_table string, row_id bigint, start_pos int, end_pos int")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(spread(texts(spark, sf_dir, "documents", "units", "translations")))
