"""Queries over the catalogue, the readers' state and the coverage of works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as K
from ..operators import overlay as O
from ..sources import table
from .registry import query

WORDS_SQL = "CASE WHEN lang = 'ja' THEN CAST(floor(length(text) / 2.5) AS INTEGER) ELSE CAST(len(regexp_extract_all(text, '[A-Za-z’''‐-―]+')) AS INTEGER) END"


def works_with_minutes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("words", T.word_count("text", "lang"))
    return t.withColumn("minutes", T.minutes("words"))


@query("catalog_p1_projection", f"""
    SELECT doc_id, words, CAST(round_even(words / 240.0, 0) AS INTEGER) AS minutes, slug FROM (
      SELECT doc_id, {WORDS_SQL} AS words,
        CASE WHEN rtrim(substr(trim(regexp_replace(lower(coalesce(source, '') || ' ' || coalesce(form, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-') = '' THEN 'x'
             ELSE rtrim(substr(trim(regexp_replace(lower(coalesce(source, '') || ' ' || coalesce(form, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-') END AS slug
      FROM documents)""")
def projection(spark, d):
    return works_with_minutes(spark, d).select("doc_id", "words", "minutes", T.slug(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("form", F.lit("")))).alias("slug"))


@query("catalog_p2_facet_filter", f"""
    SELECT lang, n_docs, sum_minutes, longest FROM (
      SELECT lang, count(*) AS n_docs, CAST(sum(minutes) AS BIGINT) AS sum_minutes, CAST(max(minutes) AS INTEGER) AS longest
      FROM (SELECT lang, form, text, CAST(round_even(({WORDS_SQL}) / 240.0, 0) AS INTEGER) AS minutes FROM documents)
      WHERE lang IN ('en', 'ko', 'ja') AND form IN ('excerpt', 'letter', 'summary') AND minutes < 180 AND contains(lower(text), '1') AND contains(lower(text), '2')
      GROUP BY lang)""")
def facet_query(spark, d):
    docs = works_with_minutes(spark, d).withColumn("size", K.size_class("minutes"))
    kept = K.facet_filter(docs, {"lang": ["en", "ko", "ja"], "form": ["excerpt", "letter", "summary"], "size": ["short"], "source": []})
    kept = kept.where(T.matches("1 2", F.col("text"), F.lit("")))
    return kept.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("minutes").alias("sum_minutes"), F.max("minutes").alias("longest"))


@query("catalog_p2_facets_of_works", """
    SELECT work_id, form, genre FROM works
    WHERE form IN ('novel', 'collection') AND orig IN ('en') AND least(1930, CAST(floor(pub_year / 10.0) * 10 AS INTEGER)) IN (1880, 1890, 1900, 1910)""")
def facets_of_works(spark, d):
    w = table(spark, d, "works").withColumn("decade", K.decade("pub_year"))
    return K.facet_filter(w, {"form": ["novel", "collection"], "orig": ["en"], "decade": [1880, 1890, 1900, 1910], "genre": []}).select("work_id", "form", "genre")


LATEST_SQL = """latest AS (
      SELECT reader_id, work_id, max(max_frac) AS max_frac, arg_max(frac, struct_pack(u := updated, f := frac)) AS frac, bool_or(finished) AS finished
      FROM progress WHERE reader_id IS NOT NULL AND work_id IS NOT NULL AND updated IS NOT NULL AND frac IS NOT NULL GROUP BY reader_id, work_id)"""


@query("catalog_p3_reading_states", f"""
    WITH {LATEST_SQL}, m AS (SELECT reader_id, work_id, count(*) AS marks FROM bookmarks GROUP BY reader_id, work_id)
    SELECT l.reader_id, l.work_id, concat_ws(',',
        CASE WHEN NOT (coalesce(frac, 0) > 0.002) THEN 'unread' END, CASE WHEN coalesce(frac, 0) > 0.002 AND NOT coalesce(finished, false) THEN 'reading' END,
        CASE WHEN coalesce(finished, false) THEN 'done' END, CASE WHEN coalesce(marks, 0) > 0 THEN 'marked' END) AS states
    FROM latest l LEFT JOIN m ON l.reader_id = m.reader_id AND l.work_id = m.work_id""")
def reading_states(spark, d):
    p = O.latest_progress(table(spark, d, "progress"))
    m = table(spark, d, "bookmarks").groupBy("reader_id", "work_id").agg(F.count("*").alias("marks"))
    return p.join(m, ["reader_id", "work_id"], "left").select("reader_id", "work_id", F.array_join(K.reading_states("frac", "finished", "marks"), ",").alias("states"))


COVERAGE_SQL = """cov AS (
      SELECT u.work_id, count(*) AS n_units, count(t.k) AS n_done, round_even(count(t.k) / greatest(count(*), 1)::DOUBLE, 4) AS cov
      FROM units u LEFT JOIN (SELECT DISTINCT work_id, k FROM translations WHERE t IS NOT NULL AND regexp_matches(t, '[^\\s\u3000\u00a0]')) t ON u.work_id = t.work_id AND u.k = t.k
      GROUP BY u.work_id)"""


@query("catalog_p4_coverage_states", f"""
    WITH {COVERAGE_SQL}
    SELECT work_id, concat_ws(',', CASE WHEN cov > 0 THEN 'ko' END, CASE WHEN cov >= 0.999 THEN 'kofull' END, CASE WHEN cov = 0 THEN 'enonly' END) AS states FROM cov""")
def coverage_states(spark, d):
    return O.coverage(table(spark, d, "units"), table(spark, d, "translations")).select("work_id", F.array_join(K.coverage_states("cov"), ",").alias("states"))


@query("catalog_p5_size_decade", """
    SELECT work_id, CASE WHEN read_minutes < 180 THEN 'short' WHEN read_minutes < 480 THEN 'mid' ELSE 'long' END AS size, least(1930, CAST(floor(pub_year / 10.0) * 10 AS INTEGER)) AS decade FROM works""")
def size_decade(spark, d):
    return table(spark, d, "works").select("work_id", K.size_class("read_minutes").alias("size"), K.decade("pub_year").alias("decade"))


HAY_SQL = """lower(concat_ws(' ', coalesce(title, ''), coalesce(title_ko, ''), coalesce(title_orig, ''), coalesce(author_ko, ''), coalesce(author_en, ''), coalesce(author, ''),
      coalesce(CAST(pub_year AS VARCHAR), ''), coalesce(CAST(CAST(floor(pub_year / 10.0) * 10 AS INTEGER) AS VARCHAR) || '년대', ''),
      coalesce(CASE form WHEN 'novel' THEN '장편' WHEN 'collection' THEN '단편집' WHEN 'story' THEN '단편' WHEN 'novella' THEN '중편' WHEN 'play' THEN '희곡' WHEN 'miscellany' THEN '잡문집' WHEN 'essay-novel' THEN '사상소설' END, '')))"""
CHO_SQL = """list_aggregate(list_transform(string_split(concat_ws(' ', coalesce(title_ko, ''), coalesce(author_ko, '')), ''),
      lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', CAST(floor((unicode(c) - 44032) / 588.0) AS INTEGER) + 1, 1) ELSE c END), 'string_agg', '')"""


@query("catalog_p6_token_search", f"""
    SELECT work_id FROM works WHERE contains({HAY_SQL}, 'the') AND contains({HAY_SQL}, '장편')""")
def token_search(spark, d):
    return K.search(table(spark, d, "works"), "The  장편").select("work_id")


@query("catalog_p6_initial_search", f"""
    SELECT work_id, title_ko FROM works WHERE contains({HAY_SQL}, 'ㄱㄹㅇ') OR contains(regexp_replace({CHO_SQL}, '\\s', '', 'g'), 'ㄱㄹㅇ')""")
def initial_search(spark, d):
    return K.search(table(spark, d, "works"), "ㄱㄹㅇ").select("work_id", "title_ko")


@query("catalog_p7_haystack", f"SELECT work_id, {HAY_SQL} AS hay FROM works")
def haystack(spark, d):
    w = table(spark, d, "works")
    return w.select("work_id", K.haystack(w).alias("hay"))


@query("catalog_p8_initials", f"SELECT work_id, {CHO_SQL} AS cho FROM works")
def initials(spark, d):
    w = table(spark, d, "works")
    return w.select("work_id", K.shadow(w).alias("cho"))


@query("catalog_p9_toc_filter", """
    SELECT work_id, seq, t FROM (SELECT *, count(*) OVER (PARTITION BY work_id) AS n FROM units WHERE kind = 'h') WHERE n > 15 AND contains(lower(t), 'chapter')""")
def toc_filter(spark, d):
    h = table(spark, d, "units").where("kind = 'h'")
    many = h.groupBy("work_id").agg(F.count("*").alias("n")).where("n > 15")
    return h.where(F.lower("t").contains("chapter")).join(many, "work_id", "left_semi").select("work_id", "seq", "t")


@query("catalog_p14_untranslated", """
    SELECT t.tr_id FROM translations t JOIN units u ON t.work_id = u.work_id AND t.k = u.k JOIN works w ON w.work_id = t.work_id
    WHERE NOT regexp_matches(t.t, '[가-힣]') AND length(regexp_replace(regexp_replace(t.t, '<[^>]+>', '', 'g'), '[^A-Za-z]', '', 'g')) > 12 AND w.orig = 'en'
      AND NOT (trim(regexp_replace(regexp_replace(t.t, '<[^>]+>', '', 'g'), '[\\s“”‘’"]+', ' ', 'g')) = trim(regexp_replace(regexp_replace(u.t, '<[^>]+>', '', 'g'), '[\\s“”‘’"]+', ' ', 'g'))
               AND NOT regexp_matches(regexp_replace(u.t, '<[^>]+>', '', 'g'), '(?i)\\b(?:the|and|of|to|is|you|that|with|was|his|her|it|in|for)\\b'))""")
def untranslated(spark, d):
    t, u, w = (table(spark, d, n) for n in ("translations", "units", "works"))
    j = t.join(u.select("work_id", "k", F.col("t").alias("src")), ["work_id", "k"]).join(w.where("orig = 'en'").select("work_id"), "work_id")
    return j.where(O.untranslated("src", "t")).select("tr_id")


@query("catalog_p15_markup", """
    SELECT tr_id, regexp_matches(regexp_replace(t, '</?em>|<span class="smallcaps">|</span>', '', 'g'), '<[^>]+>') AS stray,
      len(regexp_extract_all(t, '<em>')) <> len(regexp_extract_all(t, '</em>')) OR len(regexp_extract_all(t, '<span')) <> len(regexp_extract_all(t, '</span>')) AS unbalanced
    FROM translations WHERE contains(t, '<')""")
def markup(spark, d):
    t = table(spark, d, "translations").where(F.col("t").contains("<"))
    return t.select("tr_id", O.stray_markup("t").alias("stray"), O.unbalanced_markup("t").alias("unbalanced"))


@query("catalog_p16_targets", "SELECT work_id, title FROM works WHERE form IN ('novel', 'novella') AND genre IN ('mystery', 'weird', 'sf')")
def targets(spark, d):
    return table(spark, d, "works").where(F.col("form").isin("novel", "novella") & F.col("genre").isin("mystery", "weird", "sf")).select("work_id", "title")


@query("catalog_p17_speakable", "SELECT tr_id FROM translations WHERE regexp_matches(t, '[\\p{L}\\p{N}]')")
def speakable(spark, d):
    return table(spark, d, "translations").where(T.speakable("t")).select("tr_id")


@query("catalog_p18_sanity", "SELECT doc_id, length(text) < 400 AS suspicious, length(text) < 2000 AS too_short FROM documents WHERE text IS NOT NULL")
def sanity(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", (F.length("text") < 400).alias("suspicious"), (F.length("text") < 2000).alias("too_short"))


@query("catalog_a1_totals", """
    SELECT CAST(sum(n_word) AS BIGINT) AS words, CAST(sum(n_char) AS BIGINT) AS chars, CAST(sum(read_minutes) AS BIGINT) AS minutes, min(pub_year) AS first_year, max(pub_year) AS last_year,
      (SELECT work_id FROM works WHERE n_char IS NOT NULL ORDER BY n_char DESC, work_id LIMIT 1) AS longest FROM works""")
def totals(spark, d):
    w = table(spark, d, "works")
    longest = F.min_by("work_id", F.when(F.col("n_char").isNotNull(), F.struct((-F.col("n_char")).alias("n"), "work_id")))
    return w.agg(F.sum("n_word").alias("words"), F.sum("n_char").alias("chars"), F.sum("read_minutes").alias("minutes"), F.min("pub_year").alias("first_year"), F.max("pub_year").alias("last_year"), longest.alias("longest"))


@query("catalog_a2_group_counts", """
    SELECT facet, value, count(*) AS n FROM (
      SELECT 'author' AS facet, author AS value FROM works UNION ALL SELECT 'form', form FROM works UNION ALL SELECT 'genre', genre FROM works
      UNION ALL SELECT 'decade', CAST(least(1930, CAST(floor(pub_year / 10.0) * 10 AS INTEGER)) AS VARCHAR) FROM works
      UNION ALL SELECT 'size', CASE WHEN read_minutes < 180 THEN 'short' WHEN read_minutes < 480 THEN 'mid' ELSE 'long' END FROM works)
    GROUP BY facet, value""")
def group_counts(spark, d):
    w = table(spark, d, "works").select("author", "form", "genre", K.decade("pub_year").cast("string").alias("decade"), K.size_class("read_minutes").alias("size"))
    # one pass over the rows for all facets
    pairs = F.explode(F.create_map(*[x for c in ("author", "form", "genre", "decade", "size") for x in (F.lit(c), F.col(c))])).alias("facet", "value")
    return w.select(pairs).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("catalog_a3_by_decade", """
    SELECT least(1930, CAST(floor(pub_year / 10.0) * 10 AS INTEGER)) AS decade, string_agg(work_id, ',' ORDER BY pub_year, work_id) AS works FROM works GROUP BY 1""")
def by_decade(spark, d):
    w = table(spark, d, "works").withColumn("decade", K.decade("pub_year"))
    return w.groupBy("decade").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pub_year", "work_id"))), lambda x: x.work_id), ",").alias("works"))


@query("catalog_a4_author_stats", f"""
    WITH {LATEST_SQL}, p AS (SELECT work_id, max(max_frac) AS max_frac, bool_or(finished) AS finished FROM latest GROUP BY work_id)
    SELECT author, count_if(coalesce(finished, false)) AS done, count_if(NOT coalesce(finished, false) AND coalesce(max_frac, 0) > 0.002) AS reading,
      CAST(sum(read_minutes) AS BIGINT) AS minutes, round(sum(read_minutes * (1 - coalesce(max_frac, 0))), 4) AS remaining, round(count_if(coalesce(finished, false)) / greatest(count(*), 1)::DOUBLE, 6) AS done_share
    FROM works w LEFT JOIN p ON w.work_id = p.work_id GROUP BY author""")
def author_stats(spark, d):
    p = O.latest_progress(table(spark, d, "progress")).groupBy("work_id").agg(F.max("max_frac").alias("max_frac"), F.bool_or("finished").alias("finished"))
    w = table(spark, d, "works").join(p, "work_id", "left")
    done, far = F.coalesce("finished", F.lit(False)), F.coalesce("max_frac", F.lit(0.0))
    return w.groupBy("author").agg(
        F.count_if(done).alias("done"),
        F.count_if(~done & (far > 0.002)).alias("reading"),
        F.sum("read_minutes").alias("minutes"),
        F.round(F.sum(F.col("read_minutes") * (1 - far)), 4).alias("remaining"),
        F.round(F.count_if(done) / F.greatest(F.count("*"), F.lit(1)), 6).alias("done_share"),
    )


@query("catalog_a5_filtered_total", """
    SELECT (SELECT count(*) FROM works) AS of, count(*) AS n, CAST(sum(read_minutes) AS BIGINT) AS minutes FROM works WHERE form = 'novel' AND orig = 'en'""")
def filtered_total(spark, d):
    w = table(spark, d, "works")
    hit = (F.col("form") == "novel") & (F.col("orig") == "en")
    return w.agg(F.count("*").alias("of"), F.count_if(hit).alias("n"), F.sum(F.when(hit, F.col("read_minutes"))).alias("minutes"))


@query("catalog_a6_coverage", f"WITH {COVERAGE_SQL} SELECT work_id, n_units, n_done, cov FROM cov")
def coverage(spark, d):
    return O.coverage(table(spark, d, "units"), table(spark, d, "translations"))


@query("catalog_a6_coverage_total", f"WITH {COVERAGE_SQL} SELECT CAST(sum(n_done) AS BIGINT) AS n_done, CAST(sum(n_units) AS BIGINT) AS n_units, round_even(sum(n_done) * 100.0 / greatest(sum(n_units), 1), 2)::DOUBLE AS pct FROM cov")
def coverage_total(spark, d):
    c = O.coverage(table(spark, d, "units"), table(spark, d, "translations"))
    return c.agg(F.sum("n_done").alias("n_done"), F.sum("n_units").alias("n_units"), F.bround(F.sum("n_done") * 100.0 / F.greatest(F.sum("n_units"), F.lit(1)), 2).alias("pct"))


@query("catalog_a18_all_translated", f"WITH {COVERAGE_SQL} SELECT bool_and(cov >= 0.999) AS all_full, bool_or(cov >= 0.9) AS any_most FROM cov")
def all_translated(spark, d):
    return O.coverage(table(spark, d, "units"), table(spark, d, "translations")).agg(F.bool_and(F.col("cov") >= 0.999).alias("all_full"), F.bool_or(F.col("cov") >= 0.9).alias("any_most"))


@query("catalog_a19_state_counts", f"""
    WITH {LATEST_SQL}
    SELECT state, count(*) AS n FROM (
      SELECT 'unread' AS state FROM latest WHERE NOT (coalesce(frac, 0) > 0.002) UNION ALL
      SELECT 'reading' FROM latest WHERE coalesce(frac, 0) > 0.002 AND NOT coalesce(finished, false) UNION ALL
      SELECT 'done' FROM latest WHERE coalesce(finished, false)) GROUP BY state""")
def state_counts(spark, d):
    p = O.latest_progress(table(spark, d, "progress"))
    return p.select(F.explode(K.reading_states("frac", "finished", F.lit(0))).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


for _mode, _sql in {
    "era": "pub_year NULLS LAST",
    "author": "author NULLS LAST",
    "title": "title NULLS LAST",
    "length": "read_minutes NULLS LAST",
}.items():

    @query(f"catalog_o1_sort_{_mode}", f"SELECT CAST(row_number() OVER (ORDER BY {_sql}, author, pub_year, title, work_id) AS INTEGER) AS place, work_id FROM works")
    def sorted_works(spark, d, mode=_mode):
        w = K.sort_works(table(spark, d, "works"), mode)
        return w.select(F.row_number().over(Window.orderBy(*K.SORTS[mode](), "author", "pub_year", "title", "work_id")).alias("place"), "work_id")


@query("catalog_o3_suggestions", f"SELECT work_id FROM works WHERE contains({HAY_SQL}, 'the') ORDER BY author, pub_year, title, work_id LIMIT 8")
def suggestions(spark, d):
    return K.top(K.search(table(spark, d, "works"), "the"), 8, "author", "pub_year", "title", "work_id").select("work_id")


@query("catalog_o4_overflow", """
    SELECT author, CAST(least(count(*), 3) AS BIGINT) AS shown, CAST(greatest(count(*) - 3, 0) AS BIGINT) AS more FROM works GROUP BY author""")
def overflow(spark, d):
    return table(spark, d, "works").groupBy("author").agg(F.least(F.count("*"), F.lit(3)).cast("bigint").alias("shown"), F.greatest(F.count("*") - 3, F.lit(0)).cast("bigint").alias("more"))


@query("catalog_o6_by_count", """
    SELECT CAST(row_number() OVER (ORDER BY n DESC, genre NULLS FIRST) AS INTEGER) AS place, genre, n FROM (SELECT genre, count(*) AS n FROM works GROUP BY genre)""")
def by_count(spark, d):
    g = table(spark, d, "works").groupBy("genre").agg(F.count("*").alias("n"))
    return g.select(F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_first("genre"))).alias("place"), "genre", "n")


@query("catalog_o7_locale_order")
def locale_order(spark, d):
    """Titles in the order of the Unicode collation; DuckDB's collations differ."""
    return table(spark, d, "works").select("work_id", "title").orderBy(F.collate("title", "UNICODE"), "work_id")


@query("catalog_o8_fuzzy_rank", """
    WITH RECURSIVE w AS (SELECT work_id, string_split(lower(s), '') AS cs FROM (SELECT work_id, unnest([title, title_ko, title_orig, author_ko, author_en]) AS s FROM works) WHERE s IS NOT NULL),
      f AS (SELECT work_id, cs, 0 AS j, 0 AS i, 0 AS score, 0 AS streak FROM w
        UNION ALL SELECT work_id, cs, j + 1, CASE WHEN i < 4 AND cs[j + 1] = ('hfer')[i + 1] THEN i + 1 ELSE i END,
          CASE WHEN i < 4 AND cs[j + 1] = ('hfer')[i + 1] THEN score + (streak + 1) * 2 + CASE WHEN j = 0 THEN 6 ELSE 0 END ELSE score END,
          CASE WHEN i < 4 AND cs[j + 1] = ('hfer')[i + 1] THEN streak + 1 WHEN i < 4 THEN 0 ELSE streak END FROM f WHERE j < len(cs)),
      best AS (SELECT work_id, max(score) AS score FROM f WHERE j = len(cs) AND i = 4 GROUP BY work_id)
    SELECT best.work_id, score FROM best JOIN works ON best.work_id = works.work_id ORDER BY score DESC, author, pub_year, title, best.work_id LIMIT 40""")
def fuzzy_rank(spark, d):
    return K.rank_fuzzy(table(spark, d, "works"), "hfer").select("work_id", "score")


@query("catalog_o9_preference_score", """
    SELECT author, arg_max(work_id, struct_pack(s := s, w := work_id)) AS pick FROM (
      SELECT author, work_id, CASE WHEN form = 'novel' THEN 4 ELSE 0 END + CASE WHEN genre IN ('sf', 'weird') THEN 2 ELSE 0 END + CASE WHEN read_minutes < 180 THEN 1 ELSE 0 END AS s FROM works) GROUP BY author""")
def preference(spark, d):
    s = F.when(F.col("form") == "novel", 4).otherwise(0) + F.when(F.col("genre").isin("sf", "weird"), 2).otherwise(0) + F.when(F.col("read_minutes") < 180, 1).otherwise(0)
    return table(spark, d, "works").groupBy("author").agg(F.max_by("work_id", F.struct(s.alias("s"), "work_id")).alias("pick"))


@query("catalog_j14_neighbours", """
    SELECT work_id, lag(work_id) OVER w AS prev, lead(work_id) OVER w AS next FROM works WINDOW w AS (PARTITION BY author ORDER BY pub_year, title, work_id)""")
def neighbours(spark, d):
    w = Window.partitionBy("author").orderBy("pub_year", "title", "work_id")
    return table(spark, d, "works").select("work_id", F.lag("work_id").over(w).alias("prev"), F.lead("work_id").over(w).alias("next"))


@query("catalog_o1_sort_recent", f"""
    WITH {LATEST_SQL}, u AS (SELECT work_id, max(updated) AS updated FROM progress WHERE reader_id IS NOT NULL AND work_id IS NOT NULL AND updated IS NOT NULL AND frac IS NOT NULL GROUP BY work_id)
    SELECT CAST(row_number() OVER (ORDER BY updated DESC NULLS LAST, pub_year NULLS LAST, author, pub_year, title, w.work_id) AS INTEGER) AS place, w.work_id FROM works w LEFT JOIN u ON w.work_id = u.work_id""")
def sort_recent(spark, d):
    p = O.latest_progress(table(spark, d, "progress")).groupBy("work_id").agg(F.max("updated").alias("updated"))
    w = K.sort_works(table(spark, d, "works").join(p, "work_id", "left"), "recent")
    return w.select(F.row_number().over(Window.orderBy(*K.SORTS["recent"](), "author", "pub_year", "title", "work_id")).alias("place"), "work_id")
