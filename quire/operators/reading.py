"""Reading state from events and saved positions, as batch operators; the streaming module keeps the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import windows as W
from .overlay import filled


#: Microseconds that one block of a running value over times spans.
DAY = 86_400_000_000


def micros(x: Column | str) -> Column:
    """Microseconds of a time, with or without a zone (the session's)."""
    return F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp"))


def with_gaps(events: DataFrame, key: str, at: str, tie: str, idle: float, name: str = "session") -> DataFrame:
    """Adds gap (seconds since the event before) and the session number, new after more than idle seconds."""
    x = W.beside(events.withColumn("__o", micros(at)), key, "__o", "__o", "__was", tie=tie, block=DAY)
    x = x.withColumn("gap", (F.col("__o") - F.col("__was")) / 1e6)
    x = W.running(x, key, "__o", "__s", F.when(F.col("gap").isNull() | (F.col("gap") > idle), 1).otherwise(0), block=DAY, tie=tie)
    return x.withColumn(name, F.col("__s").cast("int")).drop("__o", "__was", "__s")


def reading_seconds(events: DataFrame, key: str, at: str, tie: str, idle: float = 90.0, tick: float = 15.0) -> DataFrame:
    """Seconds read by key: whole ticks between events at most idle seconds apart; longer pauses don't count."""
    x = with_gaps(events, key, at, tie, idle)
    ticks = F.when(F.col("gap") <= idle, F.floor(F.col("gap") / tick)).otherwise(0)
    return x.groupBy(key).agg((F.coalesce(F.sum(ticks), F.lit(0)) * int(tick)).cast("bigint").alias("seconds"), F.max("session").alias("sessions"))


def speeds(progress: DataFrame, least_s: float = 300.0, low: float = 60.0, high: float = 450.0) -> DataFrame:
    """reader_id, work_id, updated, wpm of df(reader_id, work_id, updated epoch ms, chars): words a minute over each segment, between low and high.

    A segment begins at a state and ends at the first that is at least least_s seconds later, where the next begins; that is a chunk filled
    with the time to the next state, so a reader's states are cut as overlay.filled() cuts a work, in blocks.
    """
    x = progress.select(F.to_json(F.struct("reader_id", "work_id")).alias("__key"), "reader_id", F.col("work_id").alias("__work"), "updated", "chars").withColumnRenamed("__key", "work_id")
    # numbered in order of time; equal times by what was read
    x = W.running(x, "work_id", "updated", "__n", F.lit(1), tie="chars", block=86_400_000)
    x = stored(x.withColumn("seq", (F.col("__n") - 1).cast("int")).drop("__n"))
    x = stored(W.beside(x, "work_id", "seq", "updated", "__next", after=True))
    gap = F.coalesce(F.col("__next") - F.col("updated"), F.lit(0))
    c = filled(x.select("work_id", "seq", gap.alias("len"), F.lit(False).alias("head")), int(least_s * 1000))
    begins = c.groupBy("work_id", "chunk").agg(F.min("seq").alias("seq")).join(x, ["work_id", "seq"]).drop("__next")
    before = begins.select("work_id", (F.col("chunk") + 1).alias("chunk"), F.col("updated").alias("__u"), F.col("chars").alias("__c"))
    dt, dc = (F.col("updated") - F.col("__u")) / 60000.0, F.col("chars") - F.col("__c")
    s = begins.join(before, ["work_id", "chunk"]).where(dc > 0).withColumn("wpm", dc / 5.5 / dt).where((F.col("wpm") > low) & (F.col("wpm") < high))
    return s.select("reader_id", F.col("__work").alias("work_id"), "updated", "wpm")


def smoothed(samples: Column, start: int = 200) -> Column:
    """Reading speed after an array of samples: moved by 0.35 of the difference for the first five, then 0.15, rounded half up at every step."""
    first = F.struct(F.lit(start).cast("double").alias("v"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.floor(s.v + (x - s.v) * F.when(s.n < 5, 0.35).otherwise(0.15) + 0.5).cast("double").alias("v"), (s.n + 1).alias("n"))
    return F.aggregate(samples, first, step, lambda s: s.v.cast("int"))


def upsert(saved: DataFrame, incoming: DataFrame, done_from: float = 0.985) -> DataFrame:
    """reader_id, work_id, frac, max_frac, finished after the incoming states: the latest position, the furthest reached, finished for good."""
    cols = ["reader_id", "work_id", "updated", "frac", "max_frac", "finished"]
    x = saved.select(*cols).unionByName(incoming.select(*cols)).where("reader_id IS NOT NULL AND work_id IS NOT NULL AND updated IS NOT NULL AND frac IS NOT NULL")
    g = x.groupBy("reader_id", "work_id").agg(F.max_by("frac", F.struct("updated", "frac")).alias("frac"), F.max(F.greatest("max_frac", "frac")).alias("max_frac"), F.bool_or(F.coalesce("finished", F.lit(False))).alias("f"))
    return g.select("reader_id", "work_id", "frac", "max_frac", (F.col("f") | (F.col("max_frac") >= done_from)).alias("finished"))


def last_of_window(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """The last event of each key in each window of so many seconds: what a trailing throttle lets through."""
    slot = F.floor(F.col(at).cast("timestamp").cast("double") / seconds)
    return events.groupBy(key, slot.alias("slot")).agg(F.max(F.struct(at, tie)).alias("x")).select(key, "slot", F.col("x")[tie].alias(tie))


def contiguous(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of each key up to its first missing number, from 0: what can be consumed in order."""
    return W.renumber(df, key, seq, "__no").where(F.col(seq) == F.col("__no")).drop("__no")


def current_only(df: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """Rows of the newest generation of each key; results of older ones are stale. Keys are reduced on the map side before they meet."""
    newest = df.groupBy(*keys).agg(F.max(generation).alias("__g"))
    return df.join(newest, keys).where(F.col(generation) == F.col("__g")).drop("__g")


def breaker(df: DataFrame, key: str, at: str, tie: str, failed: Column, most: int = 3) -> DataFrame:
    """Adds streak, the failures in a row up to the row, and broken from most on; a success starts anew."""
    x = df.withColumn("__o", micros(at)).withColumn("__f", F.coalesce(failed, F.lit(False)).cast("int"))
    x = W.running(x, key, "__o", "__n", F.col("__f"), block=DAY, tie=tie)
    # failures up to the last success
    x = W.running(x, key, "__o", "__then", F.when(F.col("__f") == 0, F.col("__n")), "last", block=DAY, tie=tie)
    x = x.withColumn("streak", (F.col("__n") - F.coalesce("__then", F.lit(0))).cast("int")).withColumn("broken", F.col("streak") >= most)
    return x.drop("__o", "__f", "__n", "__then")


def remembered(df: DataFrame, key: str, at: str, failed: Column, hours: int = 12) -> DataFrame:
    """Adds remembered: did the key fail less than so many hours before, at an earlier time?"""
    x = df.withColumn("__o", micros(at)).withColumn("__f", F.coalesce(failed, F.lit(False)))
    g = x.groupBy(key, "__o").agg(F.bool_or("__f").alias("__f"))
    g = W.running(g, key, "__o", "__last", F.when(F.col("__f"), F.col("__o")), "last", before=True, block=DAY).drop("__f")
    j = x.drop("__f").join(g, [key, "__o"], "left")
    return j.withColumn("remembered", F.coalesce(F.col("__last") > F.col("__o") - hours * 3_600_000_000, F.lit(False))).drop("__o", "__last")


def resynced(progress: DataFrame, units: DataFrame, signatures: DataFrame) -> DataFrame:
    """reader_id, work_id, how: keep if the signature is the same; paragraph if the saved sample still begins it or another language was read; else fraction."""
    s = signatures.select("work_id", F.col("sig").alias("__sig"))
    u = units.select("work_id", F.col("seq").alias("p"), F.col("t").alias("__t"), F.col("lang").alias("__lang"))
    j = progress.join(s, "work_id", "left").join(u, ["work_id", "p"], "left")
    here = F.col("__t").isNotNull() & ((F.coalesce("lang", F.lit("en")) != F.coalesce("__lang", F.lit("en"))) | F.coalesce(F.col("__t").startswith(F.col("anchor_text")), F.lit(False)))
    return j.select("reader_id", "work_id", "updated", F.when(F.col("sig") == F.col("__sig"), "keep").when(here, "paragraph").otherwise("fraction").alias("how"))
