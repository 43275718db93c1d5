"""Reading state as streams: windows with watermarks, sessions, idempotent upserts, keyed state with carry and time to live."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stored import shared_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of all that is there."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    # a single file is read through its folder
    return source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with a timestamp of the session's zone."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour and type; events later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, idle: str = "90 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions by user that end after a pause; an approximation of the idle gate, which counts ticks."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there, each batch written once under its number, and gives the last row of every key (in append mode all rows).

    A batch that is run again overwrites its own folder, so results are exactly once.
    """
    spark = stream.sparkSession
    at = shared_dir(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")
    if mode == "append":
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def run_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_to_table(hourly(event_stream(spark, sf_dir), "60 days"), ["hour", "event_type"])
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def speed_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keyed state of a reader: where and when the segment began, speed, samples. A segment of five minutes gives a sample, which moves the speed."""
    start, chars, wpm, n = state.get if state.exists else (None, None, 200.0, 0)
    if not state.hasTimedOut:
        for b in batches:
            for t, c in sorted(zip(b.at_ms, b.chars, strict=True)):
                if start is None:
                    start, chars = float(t), float(c)
                elif t - start >= 300_000:
                    if c > chars:
                        sample = (c - chars) / 5.5 / ((t - start) / 60_000)
                        if 60 < sample < 450:
                            wpm = float(int(wpm + (sample - wpm) * (0.35 if n < 5 else 0.15) + 0.5))
                            n += 1
                    start, chars = float(t), float(c)
    state.update((start, chars, wpm, n))
    yield pd.DataFrame({"reader_id": [key[0]], "wpm": [int(wpm)], "samples": [n]})


def speeds(positions: DataFrame) -> DataFrame:
    """Smoothed speed by reader of a stream (reader_id, at_ms, chars)."""
    return positions.groupBy("reader_id").applyInPandasWithState(speed_state, "reader_id bigint, wpm int, samples int", "start double, chars double, wpm double, n int", "update", GroupStateTimeout.NoTimeout)


def quote_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keyed state of a work: the quotation mark that the last paragraph left open. A heading closes it."""
    from ..functions.quotes import left_open
    from ..functions.quotes import quotations as found

    carry = state.get[0] if state.exists else None
    out = []
    rows = list(batches)  # those of one work in one micro-batch
    if rows:
        for seq, kind, t in pd.concat(rows).sort_values("seq")[["seq", "kind", "t"]].itertuples(index=False):
            out += [(key[0], seq, *x) for x in found(t or "", "“", None if kind == "h" else carry)]
            carry = left_open(t or "", "“")
    state.update((carry,))
    yield pd.DataFrame(out, columns=["work_id", "seq", "s", "e", "continued"], dtype=object)


def quotations(units: DataFrame) -> DataFrame:
    """Quotations of a stream (work_id, seq, kind, t) whose batches hold later paragraphs of a work after earlier ones."""
    return units.groupBy("work_id").applyInPandasWithState(quote_state, "work_id string, seq int, s int, e int, continued boolean", "carry string", "append", GroupStateTimeout.NoTimeout)


def undo_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keyed undo stack: the last five positions of the last thirty seconds; an undo (null position) takes the newest off."""
    stack = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
    out = []
    for b in batches:
        for t, p in sorted(zip(b.at_ms, b.p, strict=True), key=lambda x: x[0]):
            stack = [x for x in stack if t - x[0] <= 30_000]
            if pd.isna(p):
                out.append((key[0], int(t), stack.pop()[1] if stack else None))
            else:
                stack = [*stack, (int(t), int(p))][-5:]
    state.update(([x[0] for x in stack], [x[1] for x in stack]))
    yield pd.DataFrame(out, columns=["reader_id", "at_ms", "p"])


def undos(actions: DataFrame) -> DataFrame:
    return actions.groupBy("reader_id").applyInPandasWithState(undo_state, "reader_id bigint, at_ms bigint, p int", "at array<bigint>, p array<int>", "append", GroupStateTimeout.NoTimeout)


def adapt(ratios: list[float], workers: int, steps: int, most_workers: int = 4, least_steps: int = 4, most_steps: int = 8) -> tuple[str, int, int]:
    """What to do at the upper median of at least four ratios by worker: add a worker over 0.75, step down over 0.85, step up under 0.35."""
    if len(ratios) < 4:
        return "wait", workers, steps
    load = sorted(ratios)[len(ratios) // 2] / max(1, workers)
    if load > 0.75 and workers < most_workers:
        return "worker", workers + 1, steps
    if load > 0.85 and steps > least_steps:
        return "down", workers, steps - 1
    if load < 0.35 and steps < most_steps:
        return "up", workers, steps + 1
    return "keep", workers, steps
