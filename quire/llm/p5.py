"""Problem 5: values cut on their way, and how often each feed and source cuts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, spread, table
from .truncation import fit, learn, rows_of, score

#: Stored values that the classifier's examples are made of, about, picked by a hash of their ids, and the log odds over which a value counts as cut
#: (cut values are few, so more than even odds are asked for); every row is scored whole.
SAMPLE, CUT_OVER = 15000, 1.0


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, row_id, text, origin (feed or source), heading of documents and translations."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), "text", F.col("source").alias("origin"), F.lit(False).alias("heading"))
    t = table(spark, sf_dir, "translations").select(F.lit("translations").alias("src_table"), F.col("tr_id").alias("row_id"), F.col("t").alias("text"), F.col("feed").alias("origin"), F.coalesce(F.col("k").startswith("h:"), F.lit(False)).alias("heading"))
    return d.unionByName(t)


def fit_on_sample(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from about sample values, each whole. The executors make the examples and their features; the numbers of these come to the driver."""
    n = rows.count()
    if not n:
        return fit([])
    grid = 1 << 24
    picked = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("src_table", "row_id"), F.lit(grid)) < int(min(1.0, sample / n) * grid) + 1))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            made = [r for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows_of(t, h)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int32()), pa.array([r[1] for r in made], pa.list_(pa.int32())), pa.array([r[2] for r in made], pa.list_(pa.string()))], ["kind", "features", "closing"])

        return run

    # the sample is spread over the cores by a hash of its texts
    few = picked.select("text", "heading").repartition(rows.sparkSession.sparkContext.defaultParallelism, "text")
    got = map_rows(few, make, "kind int, features array<int>, closing array<string>").toArrow().combine_chunks()
    features = got["features"].combine_chunks()
    kinds, sizes = got["kind"].to_numpy(), features.value_lengths().to_numpy() if len(features) else np.zeros(0, np.int64)
    return learn(kinds.astype(np.int64), features.flatten().to_numpy().astype(np.int64), sizes.astype(np.int64), got["closing"].to_pylist())


def scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """src_table, row_id, origin, log_odds (null without letters), cut for every row. A narrow map; null and blank texts are not cut."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        w = shared.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            z = [score(w, t, h) for t, h in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            odds = pa.array([None if x == float("-inf") else x for x in z], pa.float64())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), odds, pa.array([x > CUT_OVER for x in z], pa.bool_())], ["src_table", "row_id", "origin", "log_odds", "cut"])

        return run

    return map_rows(rows.select("src_table", "row_id", "origin", "text", "heading"), make, "src_table string, row_id bigint, origin string, log_odds double, cut boolean")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, sf_dir)
    return scored(spread(rows), fit_on_sample(rows))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_scores(spark, sf_dir).where("cut").select("src_table", "row_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, cut rows and their share by feed or source; null origins are a group of their own."""
    return (
        p5_scores(spark, sf_dir)
        .groupBy("src_table", "origin")
        .agg(F.count("*").alias("n_rows"), F.count_if("cut").alias("n_cut"))
        .withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_rows"), 6))
    )
