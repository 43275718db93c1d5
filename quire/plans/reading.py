"""Queries on reading state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reading as S
from ..sources import table
from ..streaming import reading as stream
from .registry import query

GAPS = "g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)"


@query("stream_st1_idle_gate", f"""
    WITH {GAPS} SELECT user_id, CAST(sum(CASE WHEN gap <= 900 THEN floor(gap / 15) ELSE 0 END) * 15 AS BIGINT) AS seconds, CAST(count_if(gap IS NULL OR gap > 900) AS INTEGER) AS sessions FROM g GROUP BY user_id""")
def idle_gate(spark, d):
    return S.reading_seconds(table(spark, d, "events"), "user_id", "ts", "event_id", idle=900.0)


@query("stream_st2_speeds", """
    WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY updated, chars) AS n FROM (
        SELECT DISTINCT reader_id, updated, CAST(floor(frac * 100000) AS BIGINT) AS chars FROM progress WHERE updated IS NOT NULL AND frac IS NOT NULL AND reader_id IS NOT NULL)),
      f AS (SELECT reader_id, n, updated, chars, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS c FROM p WHERE n = 1
        UNION ALL SELECT f.reader_id, x.n, x.updated, x.chars, f.updated, f.chars FROM f, LATERAL (SELECT n, updated, chars FROM p WHERE p.reader_id = f.reader_id AND p.n > f.n AND p.updated - f.updated >= 300000 ORDER BY n LIMIT 1) x)
    SELECT reader_id, updated, round((chars - c) / 5.5 / ((updated - u) / 60000.0::DOUBLE), 4)::DOUBLE AS wpm FROM f
    WHERE chars > c AND (chars - c) / 5.5 / ((updated - u) / 60000.0::DOUBLE) > 0.05 AND (chars - c) / 5.5 / ((updated - u) / 60000.0::DOUBLE) < 450""")
def speeds(spark, d):
    """Speeds of each reader over segments of five minutes and more; the states lie days apart, so the least speed is far lower than a reader's."""
    p = table(spark, d, "progress").where("updated IS NOT NULL AND frac IS NOT NULL AND reader_id IS NOT NULL")
    p = p.select("reader_id", F.lit("").alias("work_id"), "updated", F.floor(F.col("frac") * 100000).alias("chars")).distinct()
    return S.speeds(p, low=0.05).select("reader_id", "updated", F.round("wpm", 4).alias("wpm"))


@query("stream_st3_smoothed", """
    WITH RECURSIVE s AS (SELECT user_id, value * 10 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 200.0::DOUBLE AS v FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT f.user_id, s.n, floor(f.v + (s.x - f.v) * CASE WHEN f.n < 5 THEN 0.35 ELSE 0.15 END::DOUBLE + 0.5)::DOUBLE FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
    SELECT user_id, CAST(arg_max(v, n) AS INTEGER) AS wpm FROM f GROUP BY user_id""")
def smoothed(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x.value * 10).alias("xs"))
    return e.select("user_id", S.smoothed(F.col("xs")).alias("wpm"))


@query("stream_st4_upsert", """
    WITH p AS (SELECT * FROM progress WHERE reader_id IS NOT NULL AND work_id IS NOT NULL AND updated IS NOT NULL AND frac IS NOT NULL)
    SELECT reader_id, work_id, arg_max(frac, struct_pack(u := updated, f := frac)) AS frac, max(greatest(max_frac, frac)) AS max_frac, bool_or(coalesce(finished, false)) OR max(greatest(max_frac, frac)) >= 0.985 AS finished FROM p GROUP BY reader_id, work_id""")
def upsert(spark, d):
    p = table(spark, d, "progress")
    done = F.coalesce("finished", F.lit(False))
    return S.upsert(p.where(done), p.where(~done))


@query("stream_st6_throttle", """
    SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1, 2""")
def throttle(spark, d):
    return S.last_of_window(table(spark, d, "events"), "user_id", "ts", "event_id", 3600)


@query("stream_st8_failure_memory", """
    SELECT event_id, EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND f.ts < e.ts AND f.ts > e.ts - INTERVAL 12 HOUR) AS remembered FROM events e""")
def failure_memory(spark, d):
    return S.remembered(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error").select("event_id", "remembered")


@query("stream_st10_contiguous", """
    SELECT work_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY seq) - 1 AS n FROM units WHERE length(t) > 20) WHERE seq = n""")
def contiguous(spark, d):
    return S.contiguous(table(spark, d, "units").where(F.length("t") > 20), "work_id", "seq").select("work_id", "seq")


@query("stream_st11_current", """
    SELECT tr_id FROM (SELECT *, max(rev) OVER (PARTITION BY work_id, k) AS g FROM translations WHERE work_id IS NOT NULL AND k IS NOT NULL) WHERE rev = g""")
def current(spark, d):
    t = table(spark, d, "translations").where("work_id IS NOT NULL AND k IS NOT NULL")
    return S.current_only(t, ["work_id", "k"], "rev").select("tr_id")


@query("stream_st13_breaker", """
    WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
    SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS INTEGER) AS streak, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w >= 3 AS broken FROM r WINDOW w AS (PARTITION BY user_id, r ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def breaker(spark, d):
    return S.breaker(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error").select("event_id", "streak", "broken")


@query("stream_st15_resync", """
    SELECT p.reader_id, p.work_id, p.updated, CASE WHEN p.sig = s.sig THEN 'keep' WHEN u.t IS NOT NULL AND (coalesce(p.lang, 'en') <> coalesce(u.lang, 'en') OR coalesce(starts_with(u.t, p.anchor_text), false)) THEN 'paragraph' ELSE 'fraction' END AS how
    FROM progress p LEFT JOIN (SELECT work_id, min(sig) AS sig FROM progress GROUP BY work_id) s ON p.work_id = s.work_id LEFT JOIN units u ON u.work_id = p.work_id AND u.seq = p.p""")
def resync(spark, d):
    p = table(spark, d, "progress")
    sig = p.groupBy("work_id").agg(F.min("sig").alias("sig"))
    return S.resynced(p, table(spark, d, "units"), sig)


@query("ext_stream_hourly", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def hourly(spark, d):
    """Events by hour and type, run as a stream to its end: watermark, event-time windows, results upserted by batch."""
    return stream.run_hourly(spark, d)


@query("stream_st16_open_quotations")
def open_quotations(spark, d):
    """Quotations of the English units, read as a stream with the open mark of each work as state; equal to the batch operator (tests)."""
    u = stream.table_stream(spark, d, "units").where("lang = 'en' AND t IS NOT NULL").select("work_id", "seq", "kind", "t")
    return stream.run_to_table(stream.quotations(u), [], "append")


@query("stream_st7_undo")
def undo(spark, d):
    """Positions that undo brings back, from the events as a stream: errors undo, other events set a position."""
    e = stream.event_stream(spark, d).select(F.col("user_id").alias("reader_id"), F.unix_millis("ts").alias("at_ms"), F.when(F.col("event_type") != "error", (F.col("event_id") % 1000000).cast("int")).alias("p"))
    return stream.run_to_table(stream.undos(e), [], "append")
