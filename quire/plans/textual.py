"""Queries of the text functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as T
from ..operators import windows as W
from ..sources import table
from .registry import query

U = "SELECT unit_id, {} FROM units WHERE t IS NOT NULL"


def units(spark, d):
    return table(spark, d, "units").where("t IS NOT NULL")


@query("text_f1_alnum")
def alnum(spark, d):
    return units(spark, d).select("unit_id", A.alnum("t").alias("key"))


@query("text_f2_nfc", "SELECT tr_id, trim(nfc_normalize(t), ' ' || chr(9) || chr(10) || chr(12288)) AS t FROM translations WHERE t IS NOT NULL")
def nfc(spark, d):
    return table(spark, d, "translations").where("t IS NOT NULL").select("tr_id", A.nfc("t").alias("t"))


@query("text_f3_heading_key", U.format("upper(regexp_replace(regexp_replace(regexp_replace(t, '[’‘“”\"'']', '', 'g'), '[_–—-]', ' ', 'g'), '[^A-Za-z0-9]', '', 'g')) AS key"))
def heading_key(spark, d):
    return units(spark, d).select("unit_id", T.heading_key("t").alias("key"))


@query("text_f4_slug", U.format("CASE WHEN s = '' THEN 'x' ELSE s END AS slug").replace("FROM units WHERE t IS NOT NULL", "FROM (SELECT unit_id, rtrim(substr(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-') AS s FROM units WHERE t IS NOT NULL)"))
def slug(spark, d):
    return units(spark, d).select("unit_id", T.slug("t").alias("slug"))


@query("text_f5_visible", "SELECT tr_id, trim(regexp_replace(regexp_replace(regexp_replace(t, chr(8288), '', 'g'), '[' || chr(160) || chr(8202) || ']', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM translations WHERE t IS NOT NULL")
def visible(spark, d):
    return table(spark, d, "translations").where("t IS NOT NULL").select("tr_id", T.visible("t").alias("t"))


@query("text_f6_strip_tags", U.format("regexp_replace(t, '<[^>]+>', '', 'g') AS t"))
def strip_tags(spark, d):
    return units(spark, d).select("unit_id", T.strip_tags("t").alias("t"))


@query("text_f7_html_to_text", """
    SELECT unit_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace('<h1>A</h1><p>' || t || '<br/>&amp; more</p>',
      '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|h[1-6]|li|blockquote|section|tr)\\s*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '&amp;', '&'),
      '[ \\t\\x{A0}]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS t FROM units WHERE t IS NOT NULL""")
def html_to_text(spark, d):
    page = F.concat(F.lit("<script>if (a) b('</p>')</script><style>p{}</style><h1>A</h1><p>"), F.col("t"), F.lit("<br/>&amp; more</p>"))
    return units(spark, d).select("unit_id", T.html_to_text(page).alias("t"))


@query("text_f8_escape", U.format("replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS t"))
def escape(spark, d):
    return units(spark, d).select("unit_id", T.escape("t").alias("t"))


@query("text_f9_roman", """
    WITH RECURSIVE r AS (SELECT v, s FROM (VALUES (1000,'M'),(900,'CM'),(500,'D'),(400,'CD'),(100,'C'),(90,'XC'),(50,'L'),(40,'XL'),(10,'X'),(9,'IX'),(5,'V'),(4,'IV'),(1,'I')) x(v, s)),
      f AS (SELECT i AS n, i AS rest, '' AS roman FROM generate_series(1, 3999) g(i)
        UNION ALL SELECT n, rest - v, roman || s FROM f, LATERAL (SELECT v, s FROM r WHERE v <= rest ORDER BY v DESC LIMIT 1) WHERE rest > 0)
    SELECT CAST(n AS BIGINT) AS n, roman, CAST(n AS INTEGER) AS back FROM f WHERE rest = 0""")
def roman(spark, d):
    r = spark.range(1, 4000).select(F.col("id").alias("n"), T.int_to_roman(F.col("id")).alias("roman"))
    return r.withColumn("back", T.roman_to_int("roman"))


WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
ORDERS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth"


@query("text_f10_number_words", f"""
    WITH u AS (SELECT unnest(string_split('{WORDS}', ' ')) AS w, unnest(string_split('{ORDERS}', ' ')) AS o, unnest(range(1, 20)) AS n),
      t AS (SELECT unnest(string_split('twenty thirty forty fifty sixty seventy eighty ninety', ' ')) AS w, unnest(range(20, 100, 10)) AS n),
      names AS (SELECT w, n FROM u UNION ALL SELECT o, n FROM u UNION ALL SELECT w, n FROM t UNION ALL SELECT left(w, length(w) - 1) || 'ieth', n FROM t
        UNION ALL SELECT t.w || '-' || u.w, t.n + u.n FROM t, u WHERE u.n < 10 UNION ALL SELECT t.w || '-' || u.o, t.n + u.n FROM t, u WHERE u.n < 10),
      tokens AS (SELECT unit_id, unnest(regexp_extract_all(lower(t), '[a-z]+(?:-[a-z]+)?')) AS w FROM units WHERE t IS NOT NULL)
    SELECT tokens.w, CAST(n AS INTEGER) AS n, count(*) AS times FROM tokens JOIN names ON tokens.w = names.w GROUP BY ALL""")
def number_words(spark, d):
    """The number words of all units and how often they occur."""
    w = units(spark, d).select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit("([a-z]+(?:-[a-z]+)?)"), 1)).alias("w")).groupBy("w").agg(F.count("*").alias("times"))
    return w.withColumn("n", T.number_word("w")).where("n IS NOT NULL").select("w", "n", "times")


@query("text_f25_ruby", "SELECT work_id, 'x' || title || 'y' AS shown, title AS base, author AS kana FROM works WHERE title IS NOT NULL AND author IS NOT NULL")
def ruby(spark, d):
    html = F.concat(F.lit("x<ruby>"), "title", F.lit("<rt>"), "author", F.lit("</rt></ruby>y"))
    w = table(spark, d, "works").where("title IS NOT NULL AND author IS NOT NULL").withColumn("html", html)
    x = w.select("work_id", A.ruby_text("html").alias("shown"), F.explode(A.ruby_readings("html")).alias("r"))
    return x.select("work_id", "shown", F.expr("substring(shown, r.start + 1, r.len)").alias("base"), "r.kana")


@query("text_f26_annotated", "SELECT work_id, '<ruby>' || title || '<rt>' || author || '</rt></ruby> <em>' || author || '</em>〳〵' AS html FROM works WHERE title IS NOT NULL AND author IS NOT NULL")
def annotated(spark, d):
    note = F.concat(F.lit("｜"), "title", F.lit("《"), "author", F.lit("》 "), "author", F.lit("［＃「"), "author", F.lit("」に傍点］／＼［＃改ページ］"))
    return table(spark, d, "works").where("title IS NOT NULL AND author IS NOT NULL").select("work_id", A.annotated(note).alias("html"))


TIDY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\s*—+\\s*', ', ', 'g'), '…+|\\.{3,}', '…', 'g'), '\\s+', ' ', 'g'), '([,、])\\s*[,、]+', '\\1', 'g'), ',\\s*([.!?…])', '\\1', 'g'), '^[,\\s]+', '')) AS t"


@query("text_f15_tidy", U.format(TIDY))
def tidy(spark, d):
    return units(spark, d).select("unit_id", T.tidy("t").alias("t"))


@query("text_f17_punctuation", U.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\.(?:\\s\\.){2,}|\\.{3,}', '…', 'g'), '-{3,}', '——', 'g'), '--', '—', 'g'), '[ \\t]*(—+)[ \\t]*', '\\1', 'g'), '[ \\t]+([,;:!?])', '\\1', 'g') AS t"))
def punctuation(spark, d):
    return units(spark, d).select("unit_id", T.punctuation("t").alias("t"))


CURLY = r"""
    WITH s AS (SELECT unit_id, translate(t, '“”‘’', '""''''') AS s FROM units WHERE t IS NOT NULL)
    SELECT unit_id, coalesce(array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE
      WHEN substr(s, i, 1) = '"' THEN CASE WHEN (length(substr(s, 1, i)) - length(replace(substr(s, 1, i), '"', ''))) % 2 = 1 THEN '“' ELSE '”' END
      WHEN substr(s, i, 1) <> '''' THEN substr(s, i, 1)
      WHEN i > 1 AND NOT regexp_matches(substr(s, i - 1, 1), '[\s\x{3000}\x{A0}(—\[]') AND substr(s, i - 1, 1) <> '"' THEN '’'
      WHEN i > 1 AND substr(s, i - 1, 1) = '"' AND (length(substr(s, 1, i - 1)) - length(replace(substr(s, 1, i - 1), '"', ''))) % 2 = 0 THEN '’'
      WHEN regexp_matches(substr(s, i + 1, 12), '^(?:ELIDED)(?:[^\pL\pN_]|$)') THEN '’' ELSE '‘' END), ''), '') AS t FROM s""".replace("ELIDED", "|".join(A.ELIDED))


@query("text_f18_curly", CURLY)
def curly(spark, d):
    return units(spark, d).select("unit_id", A.curly(F.translate("t", "“”‘’", "\"\"''")).alias("t"))


@query("text_f19_small_caps")
def small_caps(spark, d):
    return units(spark, d).select("unit_id", A.small_caps(F.concat(F.upper(F.substring("t", 1, 24)), F.expr("substring(t, 25)"))).alias("t"))


@query("text_f20_emphasis")
def emphasis(spark, d):
    return units(spark, d).select("unit_id", A.emphasis(F.regexp_replace("t", "</?em>", "_")).alias("t"))


@query("text_f21_unwrap", """
    SELECT doc_id, coalesce(list_reduce(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> ''),
      lambda a, b: CASE WHEN regexp_matches(a, '[-—]$') THEN a || b ELSE a || ' ' || b END), '') AS t FROM documents WHERE text IS NOT NULL""")
def unwrap(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.unwrap(F.split("text", "\n", -1)).alias("t"))


@query("text_f22_middle_out", U.format("CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 38) || ' … ' || right(t, 38) END AS t"))
def middle_out(spark, d):
    return units(spark, d).select("unit_id", T.middle_out("t").alias("t"))


@query("text_f23_width", U.format("CAST(length(t) + len(regexp_extract_all(t, '[\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33CF}\\x{3400}-\\x{4DB5}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}]')) AS INTEGER) AS width"))
def width(spark, d):
    return units(spark, d).select("unit_id", T.display_width("t").cast("int").alias("width"))


@query("text_f23_wrap")
def wrap(spark, d):
    return units(spark, d).select("unit_id", A.wrap("t").alias("t"))


@query("text_f24_hiragana", U.format("array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) BETWEEN 12449 AND 12534 THEN chr(unicode(c) - 96) ELSE c END), '') AS t"))
def hiragana(spark, d):
    return units(spark, d).select("unit_id", T.hiragana("t").alias("t"))


@query("text_f27_titles", """
    WITH p AS (SELECT work_id, title, CASE WHEN instr(title, '; or, ') > 0 THEN instr(title, '; or, ') WHEN instr(title, ': ') > 0 THEN instr(title, ': ') WHEN instr(title, ' — ') > 0 THEN instr(title, ' — ') ELSE instr(title, ' (') END AS pos FROM works)
    SELECT work_id, CASE WHEN pos > 0 THEN trim(substr(title, 1, pos - 1)) ELSE trim(title) END AS title, CASE WHEN pos > 0 THEN trim(regexp_replace(substr(title, pos), '^(?:; or, |: | — | \\()|\\)$', '', 'g')) ELSE '' END AS sub,
      CASE WHEN length(title) <= 10 THEN 's' WHEN length(title) <= 20 THEN 'm' WHEN length(title) <= 34 THEN 'l' ELSE 'xl' END AS size FROM p WHERE title IS NOT NULL""")
def titles(spark, d):
    s = T.split_title("title")
    return table(spark, d, "works").where("title IS NOT NULL").select("work_id", s.main.alias("title"), s["sub"].alias("sub"), T.length_class("title").alias("size"))


@query("text_f28_fuzzy_score", """
    WITH RECURSIVE w AS (SELECT work_id, string_split(lower(title), '') AS cs FROM works),
      f AS (SELECT work_id, cs, 0 AS j, 0 AS i, 0 AS score, 0 AS streak FROM w
        UNION ALL SELECT work_id, cs, j + 1, CASE WHEN i < 3 AND cs[j + 1] = ('the')[i + 1] THEN i + 1 ELSE i END,
          CASE WHEN i < 3 AND cs[j + 1] = ('the')[i + 1] THEN score + (streak + 1) * 2 + CASE WHEN j = 0 THEN 6 ELSE 0 END ELSE score END,
          CASE WHEN i < 3 AND cs[j + 1] = ('the')[i + 1] THEN streak + 1 WHEN i < 3 THEN 0 ELSE streak END FROM f WHERE j < len(cs))
    SELECT work_id, CASE WHEN i = 3 THEN score ELSE -1 END AS score FROM f WHERE j = len(cs)""")
def fuzzy(spark, d):
    return table(spark, d, "works").select("work_id", T.fuzzy_score("the", F.col("title")).alias("score"))


@query("text_f29_levenshtein")
def levenshtein(spark, d):
    """Edits from each unit to the one before it, fragment by fragment as speech is compared, so that a long text costs no square of its length. DuckDB counts bytes, so this is held against a plain loop in the tests."""
    u = table(spark, d, "units").where("t IS NOT NULL").select("unit_id", "work_id", "seq", "t", F.coalesce("lang", F.lit("en")).alias("lang"))
    cut = F.transform(A.fragments("t", F.col("lang")), lambda x: F.substr(F.col("t"), x.s + 1, x.e - x.s))
    x = W.beside(u.select("unit_id", "work_id", "seq", cut.alias("fs")), "work_id", "seq", "fs", "was").where("was IS NOT NULL")
    edits = F.zip_with("fs", "was", lambda a, b: F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return x.select("unit_id", F.aggregate(edits, F.lit(0), lambda a, n: a + n).alias("d"))


@query("text_f29_words")
def word_edits(spark, d):
    """Edits by words from each unit to the one before it, whole texts."""
    u = table(spark, d, "units").where("t IS NOT NULL").select("unit_id", "work_id", "seq", "t")
    x = W.beside(u, "work_id", "seq", "t", "was").where("was IS NOT NULL").withColumn("c", F.split(A.two_codes("t", F.col("was")), "\n"))
    return x.select("unit_id", F.levenshtein(F.col("c")[0], F.col("c")[1]).alias("d"))


@query("text_f37_formats", """
    SELECT work_id, CASE WHEN read_minutes < 1 THEN '1분 미만' WHEN read_minutes < 60 THEN read_minutes || '분' WHEN read_minutes % 60 > 0 THEN (read_minutes // 60) || '시간 ' || (read_minutes % 60) || '분' ELSE (read_minutes // 60) || '시간' END AS label FROM works WHERE read_minutes IS NOT NULL""")
def formats(spark, d):
    return table(spark, d, "works").where("read_minutes IS NOT NULL").select("work_id", T.minutes_label("read_minutes").alias("label"))


@query("text_f37_ago", """
    SELECT mark_id, CASE WHEN s < 60 THEN '방금' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || '분 전' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || '시간 전' WHEN s < 172800 THEN '어제'
      WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || '일 전' WHEN s < 2592000 THEN CAST(floor(s / 604800) AS BIGINT) || '주 전' ELSE CAST(floor(s / 2592000) AS BIGINT) || '개월 전' END AS label
    FROM (SELECT mark_id, (1735689600000 - created) / 1000.0 AS s FROM bookmarks WHERE created IS NOT NULL)""")
def ago(spark, d):
    return table(spark, d, "bookmarks").where("created IS NOT NULL").select("mark_id", T.ago_label((F.lit(1735689600000) - F.col("created")) / 1000.0).alias("label"))


@query("text_f38_hashes", """
    SELECT work_id, md5(work_id) AS m, CAST(('0x' || substr(md5(work_id), 1, 8))::BIGINT % 4 AS BIGINT) AS bucket,
      list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(title, ''), lambda c: CAST(unicode(c) & 255 AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fnv FROM works""")
def hashes(spark, d):
    bucket = F.conv(F.substring(F.md5("work_id"), 1, 8), 16, 10).cast("bigint") % 4
    return table(spark, d, "works").select("work_id", F.md5("work_id").alias("m"), bucket.alias("bucket"), T.fnv1a("title").alias("fnv"))


@query("text_o5_natural_key", "SELECT unit_id, coalesce(array_to_string(list_transform(regexp_extract_all(ref, '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 12, '0') ELSE x END), ''), '') AS key FROM units")
def natural_key(spark, d):
    return table(spark, d, "units").select("unit_id", T.natural_key("ref").alias("key"))


@query("text_f37_ten_thousands", """
    SELECT work_id, CASE WHEN n_char < 10000 THEN format('{:,}자', n_char) WHEN n_char / 10000.0::DOUBLE < 100 THEN replace(printf('%.1f만', n_char / 10000.0::DOUBLE), '.0만', '만') || ' 자'
      ELSE format('{:,}만 자', CAST(round_even(n_char / 10000.0::DOUBLE, 0) AS BIGINT)) END AS label FROM works WHERE n_char IS NOT NULL""")
def ten_thousands(spark, d):
    return table(spark, d, "works").where("n_char IS NOT NULL").select("work_id", T.ten_thousands("n_char").alias("label"))


@query("text_f38_versions", """
    SELECT work_id, substr(sha1(title), 1, 8) AS v, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(title, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fnv
    FROM works WHERE title IS NOT NULL""")
def versions(spark, d):
    return table(spark, d, "works").where("title IS NOT NULL").select("work_id", T.version("title").alias("v"), T.fnv1a_utf16("title").alias("fnv"))


@query("text_m10_noise")
def noise(spark, d):
    """Four deviates of every unit; held against a plain loop in the tests."""
    return units(spark, d).select("unit_id", F.posexplode(F.transform(A.noise("t", 4), lambda x: F.round(x, 6))).alias("i", "x"))


@query("text_a25_band_means", """
    SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 5) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL""")
def band_means(spark, d):
    """Mean of each place of the vectors by label."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))
