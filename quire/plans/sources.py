"""Queries of the text sources over columns, and of a round trip through sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import table
from ..sources import text as X
from ..sources.stored import shared_dir
from .registry import query


@query("source_s4_between_marks", "SELECT doc_id, trim(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL")
def between_marks(spark, d):
    x = table(spark, d, "documents").where("text IS NOT NULL")
    framed = F.concat(F.lit("header\n*** START OF THIS TEXT ***\n"), F.col("text"), F.lit("\n*** END OF THIS TEXT ***\nfooter"))
    return x.select("doc_id", X.between_marks(framed, r"\*\*\* START OF", r"\*\*\* END OF").alias("t"))


@query("source_s5_last_section", "SELECT work_id, '@2 x ' || title || ' ' AS t FROM works WHERE title IS NOT NULL")
def last_section(spark, d):
    s = F.concat(F.lit("contents @2 @end @1 y @2 x "), F.col("title"), F.lit(" @end"))
    return table(spark, d, "works").where("title IS NOT NULL").select("work_id", X.last_section(s, "@2", "@end").alias("t"))


@query("source_s9_payloads", "SELECT work_id, CAST(pub_year AS INTEGER) AS y, title AS t FROM works")
def payloads(spark, d):
    w = table(spark, d, "works").select("work_id", F.concat(F.lit("receive("), F.to_json(F.struct(F.col("pub_year").alias("y"), F.col("title").alias("t"))), F.lit(");")).alias("js"))
    return X.payloads(w, "js", "y int, t string").select("work_id", "payload.y", "payload.t")


@query("source_s12_quarantine", """
    SELECT 'parsed' AS side, count(*) AS n FROM events WHERE event_type <> 'error' UNION ALL SELECT 'quarantined', count(*) FROM events WHERE event_type = 'error'""")
def quarantine(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), F.col("props"))).otherwise(F.col("props")).alias("props"))
    good, bad = X.kv_quarantine(e, "event_id", "props", "k int")
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(good, "parsed").unionByName(n(bad, "quarantined"))


@query("source_k6_backup", """
    SELECT reader_id, CAST(sum(p) AS BIGINT) AS n_progress, CAST(sum(m) AS BIGINT) AS n_marks FROM (SELECT reader_id, 1 AS p, 0 AS m FROM progress WHERE reader_id IS NOT NULL UNION ALL SELECT reader_id, 0, 1 FROM bookmarks WHERE reader_id IS NOT NULL) GROUP BY reader_id""")
def backup(spark, d):
    b = X.export_backup(table(spark, d, "progress").where("reader_id IS NOT NULL"), table(spark, d, "bookmarks").where("reader_id IS NOT NULL"))
    x = F.from_json("backup", "progress array<struct<p:int>>, marks array<struct<p:int>>")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return b.select("reader_id", F.when(x.progress.isNull(), 0).otherwise(size(x.progress)).cast("bigint").alias("n_progress"), F.when(x.marks.isNull(), 0).otherwise(size(x.marks)).cast("bigint").alias("n_marks"))


# ---- round trips: what is written is read again by the source that it is for


def _at(spark, name):
    return shared_dir(spark, name)


@query("source_s1_whole_texts", "SELECT work_id, title || chr(10) || '        ' || author || chr(10) AS text FROM works WHERE title IS NOT NULL AND author IS NOT NULL")
def whole_texts(spark, d):
    """One file a work, with a carriage return and a tab, read whole."""
    at = _at(spark, "s1")
    lines = F.concat("title", F.lit("\r\n\t"), "author")
    table(spark, d, "works").where("title IS NOT NULL AND author IS NOT NULL").select("work_id", lines.alias("value")).write.partitionBy("work_id").text(at)
    return X.whole_texts(spark, at).select(F.regexp_extract("path", "work_id=([^/]+)/", 1).alias("work_id"), "text")


@query("source_s10_job_outputs", """
    SELECT work_id, CASE WHEN pub_year % 5 > 0 THEN x.k END AS k, CASE WHEN pub_year % 5 > 0 THEN CASE WHEN x.k = 'h:t' THEN title ELSE author END END AS t, CASE WHEN pub_year % 5 = 0 THEN 'unreadable' END AS problem
    FROM works, (VALUES ('h:t'), ('p:0')) x(k) WHERE (pub_year % 5 > 0 OR x.k = 'p:0') AND title IS NOT NULL AND author IS NOT NULL""")
def job_outputs(spark, d):
    """One JSON file a work, each fifth year's broken."""
    at = _at(spark, "s10")
    js = F.to_json(F.create_map(F.lit("h:t"), F.col("title"), F.lit("p:0"), F.col("author")))
    w = table(spark, d, "works").where("title IS NOT NULL AND author IS NOT NULL")
    w = w.select("work_id", F.when(F.col("pub_year") % 5 == 0, F.substring(js, 1, 9)).otherwise(js).alias("value"))
    w.write.partitionBy("work_id").text(at)
    out = X.job_outputs(spark, at, "*.txt")
    return out.select(F.regexp_extract("path", "work_id=([^/]+)/", 1).alias("work_id"), "k", "t", "problem")


@query("source_s13_manifest", "SELECT work_id AS id, pub_year AS y FROM works")
def manifest(spark, d):
    """The catalogue is small, so a page holds all of it."""
    rows = F.to_json(F.collect_list(F.struct(F.col("work_id").alias("id"), F.col("pub_year").alias("y"))))
    page = table(spark, d, "works").agg(F.concat(F.lit("<script>var MANIFEST="), rows, F.lit(";</script>")).alias("html"))
    return X.manifest(page, "html", "struct<id:string,y:int>")


@query("sink_k1_payloads", "SELECT work_id, CAST(count(*) AS BIGINT) AS n, CAST(count(t) AS BIGINT) AS n_text FROM units GROUP BY work_id")
def write_payloads(spark, d):
    """A folder a work, written twice; the second run replaces the folders that it holds."""
    at = _at(spark, "k1")
    n = table(spark, d, "units").groupBy("work_id").agg(F.count("*").alias("n"), F.count("t").alias("n_text"))
    X.write_payloads(n.withColumn("n", F.lit(0)), at)
    X.write_payloads(n, at)
    return spark.read.schema("n bigint, n_text bigint, work_id string").json(at).select("work_id", "n", "n_text")


@query("sink_k2_index", "SELECT lang, count(*) AS n FROM units GROUP BY lang")
def write_index(spark, d):
    at = _at(spark, "k2")
    X.write_index(table(spark, d, "units").groupBy("lang").agg(F.count("*").alias("n")), at, "lang")
    return spark.read.schema("lang string, n bigint").json(at)


@query("sink_k3_edition", "SELECT work_id, CAST(count(*) AS BIGINT) AS n_units, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM units WHERE t IS NOT NULL GROUP BY work_id")
def write_edition(spark, d):
    """Editions read again: their letters are those of the units, in as many lines or more."""
    at = _at(spark, "k3")
    u = table(spark, d, "units").where("t IS NOT NULL")
    X.write_edition(u, at)
    back = spark.read.parquet(f"{at}/lines")
    return back.where("part = 'text'").groupBy("work_id").agg(F.count_distinct("seq").alias("n_units"), F.sum("n_source").alias("n_chars"))


@query("sink_k5_summary", "SELECT author AS a, CAST(2 * count(*) AS BIGINT) AS n FROM works WHERE author IS NOT NULL GROUP BY author")
def append_summary(spark, d):
    """A summary appended twice."""
    at = _at(spark, "k5")
    for _ in range(2):
        X.append_summary(table(spark, d, "works").where("author IS NOT NULL").groupBy("author").agg(F.count("*").alias("n")), at)
    return spark.read.option("sep", "\t").option("header", "true").schema("a string, n bigint").csv(at).groupBy("a").agg(F.sum("n").alias("n"))


@query("sink_k9_fresh", "SELECT doc_id FROM documents WHERE n_chars IS NULL OR n_chars <= 800")
def fresh(spark, d):
    """Documents to take in where those of more than 800 characters are there already."""
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"))
    return X.fresh(x, x, "doc_id", 800).select("doc_id")
