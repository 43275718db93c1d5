"""Queries on dialogue and speech: quotations, fragments, numbers in words, error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as T
from ..operators import dialogue as D
from ..operators import windows as W
from ..sources import table
from .registry import SQL, query
from .textual import TIDY


#: The same for text with wide spaces.
WIDE = TIDY.replace("[,\\s]", "[,\\s\\x{3000}]").replace("\\s*", "[\\s\\x{3000}]*").replace("'\\s+'", "'[\\s\\x{3000}]+'")


@query("speech_f11_english_numbers")
def english_numbers(spark, d):
    return table(spark, d, "units").where("lang = 'en' AND t IS NOT NULL").select("unit_id", A.spoken_en("t").alias("t"))


@query("speech_f12_korean_numbers")
def korean_numbers(spark, d):
    return table(spark, d, "translations").where("t IS NOT NULL").select("tr_id", A.spoken_ko("t").alias("t"))


@query("speech_f14_japanese", "SELECT unit_id, " + WIDE.replace("(t, ", "(regexp_replace(regexp_replace(regexp_replace(t, '[\\x{200B}\\x{AD}]', '', 'g'), '―+|─+', '、', 'g'), '[〔〕［］]', '', 'g'), ", 1) + " FROM units WHERE lang = 'ja' AND t IS NOT NULL")
def japanese(spark, d):
    return table(spark, d, "units").where("lang = 'ja' AND t IS NOT NULL").select("unit_id", A.spoken_ja("t").alias("t"))


@query("speech_f16_fragments")
def fragments(spark, d):
    u = table(spark, d, "units").where("t IS NOT NULL")
    return u.select("unit_id", F.explode(A.fragments("t", F.coalesce("lang", F.lit("en")))).alias("x")).select("unit_id", "x.s", "x.e")


@query("speech_f30_transcript_key")
def transcript_key(spark, d):
    """Keys of the units in their own language and of the translations in Korean."""
    u = table(spark, d, "units").where("t IS NOT NULL").select(F.lit("units").alias("side"), F.col("unit_id").alias("id"), A.speech_key("t", F.coalesce("lang", F.lit("en"))).alias("key"))
    return u.unionByName(table(spark, d, "translations").where("t IS NOT NULL").select(F.lit("translations").alias("side"), F.col("tr_id").alias("id"), A.speech_key("t", "ko").alias("key")))


@query("speech_f36_quote_spans")
def quote_spans(spark, d):
    """Quotations of every unit, carried over paragraphs of a chapter; a heading resets what was left open."""
    return D.quotations(table(spark, d, "units"), "t")


@query("speech_f39_model_input")
def model_input(spark, d):
    return table(spark, d, "units").where("t IS NOT NULL").select("unit_id", A.model_input("t", F.coalesce("lang", F.lit("en"))).alias("t"))


@query("speech_f40_pauses", """
    SELECT unit_id, CASE WHEN regexp_matches(t, '[.!?。！？…][”’」』)）]*$') THEN 380 WHEN regexp_matches(t, '[,、;:，；：][”’」』)）]*$') THEN 180 WHEN regexp_matches(t, '—$') THEN 260 ELSE 120 END
      + CASE WHEN nxt = 'h' THEN 900 WHEN nxt = 'p' THEN 420 ELSE 0 END AS ms FROM (SELECT *, lead(kind) OVER (PARTITION BY work_id ORDER BY seq) AS nxt FROM units) WHERE t IS NOT NULL""")
def pauses(spark, d):
    u = W.beside(table(spark, d, "units"), "work_id", "seq", "kind", "nxt", after=True)
    u = u.withColumn("b", F.when(F.col("nxt") == "h", "section").when(F.col("nxt") == "p", "paragraph"))
    return u.where("t IS NOT NULL").select("unit_id", T.pause_ms("t", "b").alias("ms"))


@query("speech_a20_opener", """
    SELECT work_id, CASE WHEN count_if(starts_with(ltrim(t), '“')) >= count_if(starts_with(ltrim(t), '‘')) THEN '“' ELSE '‘' END AS opener FROM units WHERE t IS NOT NULL GROUP BY work_id""")
def opener(spark, d):
    return D.openers(table(spark, d, "units").where("t IS NOT NULL"), "work_id", "t")


@query("speech_j12_positional", """
    WITH q AS (SELECT unit_id, len(regexp_extract_all(t, '[“「]')) AS n, work_id, k FROM units WHERE t IS NOT NULL), o AS (SELECT work_id, k, len(regexp_extract_all(t, '[“「]')) AS m FROM (
        SELECT work_id, k, arg_max(t, struct_pack(r := coalesce(rev, 0), m := made_at, i := tr_id)) AS t FROM translations WHERE work_id IS NOT NULL AND k IS NOT NULL AND regexp_matches(t, '[^\\s\u3000\u00a0]') GROUP BY work_id, k))
    SELECT unit_id, CASE WHEN n = m THEN 'exact' WHEN n = 0 THEN 'fallback' WHEN n = 1 THEN 'same' ELSE 'fallback' END AS how, CAST(CASE WHEN n = m OR n = 1 THEN m ELSE 0 END AS INTEGER) AS placed FROM q JOIN o ON q.work_id = o.work_id AND q.k = o.k""")
def positional(spark, d):
    return D.positional(table(spark, d, "units"), table(spark, d, "translations"))


@query("speech_a13_contingency", f"""
    WITH x AS ({SQL['speech_j12_positional']}) SELECT how, count(*) AS n_paragraphs, CAST(sum(len(regexp_extract_all(t, '[“「]'))) AS BIGINT) AS n_quotes FROM x JOIN units u ON x.unit_id = u.unit_id GROUP BY how""")
def contingency(spark, d):
    """Quotations of units against those of their translations, by paragraphs and by quotations."""
    return D.contingency(table(spark, d, "units"), table(spark, d, "translations"))


@query("speech_a14_error_rate", """
    SELECT feed, CAST(sum(levenshtein(a, b)) AS BIGINT) AS edits, CAST(sum(length(a)) AS BIGINT) AS n, round(sum(levenshtein(a, b)) / greatest(sum(length(a)), 1)::DOUBLE, 6) AS rate FROM (
      SELECT feed, x AS a, replace(replace(x, 'the ', ''), 'e', 'a') AS b FROM (SELECT feed, regexp_replace(u.t, '[^ -~]', '', 'g') AS x FROM translations t JOIN units u ON t.work_id = u.work_id AND t.k = u.k WHERE u.t IS NOT NULL)) GROUP BY feed""")
def error_rate(spark, d):
    u = table(spark, d, "units").where("t IS NOT NULL").select("work_id", "k", F.regexp_replace("t", "[^ -~]", "").alias("reference"))
    j = table(spark, d, "translations").select("work_id", "k", "feed").join(u, ["work_id", "k"])
    heard = F.replace(F.replace("reference", F.lit("the "), F.lit("")), F.lit("e"), F.lit("a"))
    return D.error_rates(j.select("feed", "reference", heard.alias("heard")), "feed")


@query("speech_a15_real_time_factor", "SELECT event_type, round(sum(value) / greatest(sum(value + 1), 1e-9), 6) AS rtf FROM events GROUP BY event_type")
def real_time_factor(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.greatest(F.sum(F.col("value") + 1), F.lit(1e-9)), 6).alias("rtf"))


@query("speech_a24_gated_mean", """
    WITH a AS (SELECT event_type, avg(value) AS m FROM events WHERE value > 1 GROUP BY event_type)
    SELECT e.event_type, round(avg(e.value), 6) AS gated FROM events e JOIN a ON e.event_type = a.event_type WHERE e.value > 1 AND e.value > a.m * 0.1 GROUP BY e.event_type""")
def gated_mean(spark, d):
    return D.gated_mean(table(spark, d, "events"), "event_type", "value", 1.0, 0.1)


@query("speech_j17_transcripts", """
    SELECT lang, count(*) AS n FROM (SELECT regexp_extract('v8_6_F1_' || coalesce(lang, 'xx') || seq || 'a.wav', '_(en|ko|ja)(\\d+)', 1) AS lang FROM units) WHERE lang <> '' GROUP BY lang""")
def transcripts(spark, d):
    name = F.concat(F.lit("v8_6_F1_"), F.coalesce("lang", F.lit("xx")), F.col("seq").cast("string"), F.lit("a.wav"))
    return table(spark, d, "units").select(F.regexp_extract(name, r"_(en|ko|ja)(\d+)", 1).alias("lang")).where("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"))


@query("speech_m7_blend", """
    SELECT label, round(list_aggregate(list_transform(list_zip(a, b), lambda x: round(x[1] * 0.75 + x[2] * 0.25, 4)), 'sum'), 4)::DOUBLE AS s FROM (
      SELECT label, arg_min(embedding, vec_id) AS a, arg_max(embedding, vec_id) AS b FROM embeddings GROUP BY label)""")
def blend(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"))
    mixed = F.zip_with("a", "b", lambda x, y: F.round(x.cast("double") * 0.75 + y.cast("double") * 0.25, 4))
    return e.select("label", F.round(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x), 4).alias("s"))
