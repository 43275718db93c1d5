"""Queries over overlays: joins of translations with their units, checks and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import overlay as O
from ..operators import quality as Q
from ..operators import sets as S
from ..operators import windows as W
from ..sources import table
from .registry import query

NEWEST = """newest AS (SELECT work_id, k, arg_max(t, struct_pack(r := coalesce(rev, 0), m := made_at, i := tr_id)) AS ko FROM translations
      WHERE work_id IS NOT NULL AND k IS NOT NULL AND regexp_matches(t, '[^\\s\u3000\u00a0]') GROUP BY work_id, k)"""


@query("overlay_j1_lookup", "SELECT t.tr_id, w.title_ko FROM translations t JOIN works w ON t.work_id = w.work_id")
def lookup(spark, d):
    # the catalogue is small and its size is known to the optimiser, which broadcasts it
    return table(spark, d, "translations").join(table(spark, d, "works"), "work_id").select("tr_id", "title_ko")


@query("overlay_j2_compose_both", f"""
    WITH {NEWEST}
    SELECT u.work_id, u.seq, 0 AS part, u.t FROM units u
    UNION ALL SELECT u.work_id, u.seq, 1 AS part, n.ko AS t FROM units u JOIN newest n ON u.work_id = n.work_id AND u.k = n.k""")
def compose_both(spark, d):
    return O.compose(table(spark, d, "units"), table(spark, d, "translations"), "both")


@query("overlay_j2_compose_ko", f"""
    WITH {NEWEST} SELECT u.work_id, u.seq, 0 AS part, coalesce(n.ko, u.t) AS t FROM units u LEFT JOIN newest n ON u.work_id = n.work_id AND u.k = n.k""")
def compose_ko(spark, d):
    return O.compose(table(spark, d, "units"), table(spark, d, "translations"), "ko")


@query("overlay_j3_todo", """
    SELECT u.unit_id FROM units u WHERE NOT EXISTS (SELECT 1 FROM translations t WHERE t.work_id = u.work_id AND t.k = u.k AND regexp_matches(t.t, '[^\\s\u3000\u00a0]')) ORDER BY u.unit_id LIMIT 50""")
def todo(spark, d):
    return table(spark, d, "units").join(O.delivered(table(spark, d, "translations")), ["work_id", "k"], "left_anti").select("unit_id").orderBy("unit_id").limit(50)


@query("overlay_j4_reconcile", """
    WITH u AS (SELECT DISTINCT work_id, k FROM units), t AS (SELECT DISTINCT work_id, k FROM translations WHERE work_id IS NOT NULL AND k IS NOT NULL AND regexp_matches(t, '[^\\s\u3000\u00a0]'))
    SELECT coalesce(u.work_id, t.work_id) AS work_id, coalesce(u.k, t.k) AS k, CASE WHEN u.k IS NULL THEN 'unknown' WHEN t.k IS NULL THEN 'missing' ELSE 'ok' END AS state
    FROM u FULL JOIN t ON u.work_id = t.work_id AND u.k = t.k""")
def reconcile(spark, d):
    return O.reconcile(table(spark, d, "units"), table(spark, d, "translations"))


@query("overlay_j5_known", "SELECT tr_id FROM translations t WHERE EXISTS (SELECT 1 FROM units u WHERE u.work_id = t.work_id AND u.k = t.k)")
def known(spark, d):
    return table(spark, d, "translations").join(table(spark, d, "units").select("work_id", "k"), ["work_id", "k"], "left_semi").select("tr_id")


@query("overlay_j6_orphans", """
    SELECT 'stray' AS kind, CAST(tr_id AS VARCHAR) AS id FROM translations t WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.work_id = t.work_id AND u.k = t.k)
    UNION ALL SELECT 'no units', work_id FROM works w WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.work_id = w.work_id)
    UNION ALL SELECT 'no work', doc_id::VARCHAR FROM documents x WHERE NOT EXISTS (SELECT 1 FROM works w WHERE w.work_id = x.work_id)""")
def orphans(spark, d):
    t, u, w, x = (table(spark, d, n) for n in ("translations", "units", "works", "documents"))
    a = t.join(u.select("work_id", "k"), ["work_id", "k"], "left_anti").select(F.lit("stray").alias("kind"), F.col("tr_id").cast("string").alias("id"))
    b = w.join(u.select("work_id"), "work_id", "left_anti").select(F.lit("no units").alias("kind"), F.col("work_id").alias("id"))
    c = x.join(w.select("work_id"), "work_id", "left_anti").select(F.lit("no work").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    return a.unionByName(b).unionByName(c)


@query("overlay_j9_interval_overlap", """
    SELECT a.mark_id, count(*) AS n FROM bookmarks a JOIN bookmarks b ON a.work_id = b.work_id AND a.p = b.p AND a.mark_id <> b.mark_id
      AND a.o < b.o + length(b.excerpt) AND b.o < a.o + length(a.excerpt) GROUP BY a.mark_id""")
def interval_overlap(spark, d):
    return S.overlapping(table(spark, d, "bookmarks").withColumn("s", F.col("o")).withColumn("e", F.col("o") + F.length("excerpt")), ["work_id", "p"], "mark_id")


@query("overlay_j10_carry_over")
def carry_over(spark, d):
    """The units of each work against a version of them in which those without a letter are dropped and the rest renumbered."""
    u = table(spark, d, "units").select("work_id", "seq", "k", "t")
    new = W.renumber(u.where(F.col("t").rlike(r"\p{L}")), "work_id", "seq").withColumn("k", F.concat(F.lit("n:"), F.col("no"))).drop("no")
    kept = O.newest(table(spark, d, "translations")).select("work_id", "k", F.col("ko").alias("t"))
    return O.carry_over(u, new, kept)


@query("overlay_j15_snapshot_diff", """
    WITH f AS (SELECT work_id, k, arg_min(t, struct_pack(r := coalesce(rev, 0), i := tr_id)) AS base, arg_max(t, struct_pack(r := coalesce(rev, 0), i := tr_id)) AS now FROM translations
      WHERE work_id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL GROUP BY work_id, k)
    SELECT work_id, count(*) AS n, count_if(base <> now) AS n_changed, round(count_if(base <> now) * 100.0 / count(*), 4)::DOUBLE AS pct FROM f GROUP BY work_id""")
def snapshot_diff(spark, d):
    t = table(spark, d, "translations").where("work_id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL")
    order = F.struct(F.coalesce("rev", F.lit(0)).alias("r"), "tr_id")
    base = t.groupBy("work_id", "k").agg(F.min_by("t", order).alias("t"))
    now = t.groupBy("work_id", "k").agg(F.max_by("t", order).alias("t"))
    x = O.snapshot_diff(base, now, ["work_id", "k"], "t")
    return x.groupBy("work_id").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), F.round(F.count_if("changed") * 100.0 / F.count("*"), 4).alias("pct"))


@query("overlay_a11_density", """
    SELECT work_id, CAST(sum(length(t)) AS BIGINT) AS n_chars, round(sum(len(regexp_extract_all(t, '그녀'))) * 10000.0 / sum(length(t)), 4)::DOUBLE AS she,
      round(sum(len(regexp_extract_all(t, '그 사람|그이|그쪽'))) * 10000.0 / sum(length(t)), 4)::DOUBLE AS person,
      sum(len(regexp_extract_all(t, '그 사람|그이|그쪽'))) * 10000.0 / sum(length(t)) > 30 AS dense
    FROM translations WHERE t IS NOT NULL AND work_id IS NOT NULL GROUP BY work_id HAVING sum(length(t)) >= 2000""")
def density(spark, d):
    t = table(spark, d, "translations").where("t IS NOT NULL AND work_id IS NOT NULL")
    per = lambda p: F.sum(F.regexp_count("t", F.lit(p))) * 10000.0 / F.sum(F.length("t"))
    g = t.groupBy("work_id").agg(F.sum(F.length("t")).alias("n_chars"), F.round(per("그녀"), 4).alias("she"), F.round(per("그 사람|그이|그쪽"), 4).alias("person"), (per("그 사람|그이|그쪽") > 30).alias("dense"))
    return g.where("n_chars >= 2000")


@query("overlay_a12_changed_share", """
    SELECT feed, count(*) AS n, count_if(rev > 1) AS n_rev, round(count_if(rev > 1) * 100.0 / count(*), 4)::DOUBLE AS pct FROM translations GROUP BY feed""")
def changed_share(spark, d):
    return table(spark, d, "translations").groupBy("feed").agg(F.count("*").alias("n"), F.count_if(F.expr("rev > 1")).alias("n_rev"), F.round(F.count_if(F.expr("rev > 1")) * 100.0 / F.count("*"), 4).alias("pct"))


@query("overlay_a21_warning_ratio", """
    SELECT work_id, chunk, count(*) AS n, count_if(t IS NULL OR NOT regexp_matches(t, '[^\\s\u3000\u00a0]')) AS n_blank FROM translations GROUP BY work_id, chunk HAVING count(*) >= 8 AND count_if(t IS NULL OR NOT regexp_matches(t, '[^\\s\u3000\u00a0]')) > 0.04 * count(*)""")
def warning_ratio(spark, d):
    blank = F.col("t").isNull() | T.blank("t")
    return table(spark, d, "translations").groupBy("work_id", "chunk").agg(F.count("*").alias("n"), F.count_if(blank).alias("n_blank")).where("n >= 8 AND n_blank > 0.04D * n")


@query("overlay_a23_duplicates", """
    SELECT work_id, k, count(*) AS n, min(tr_id) AS first_id FROM translations WHERE work_id IS NOT NULL AND k IS NOT NULL GROUP BY work_id, k HAVING count(*) > 1""")
def duplicates(spark, d):
    t = table(spark, d, "translations").where("work_id IS NOT NULL AND k IS NOT NULL")
    return t.groupBy("work_id", "k").agg(F.count("*").alias("n"), F.min("tr_id").alias("first_id")).where("n > 1")


@query("overlay_q3_checks", """
    WITH u AS (SELECT work_id, k FROM units), t AS (SELECT * FROM translations WHERE work_id IS NOT NULL)
    SELECT t.work_id, count_if(u.k IS NULL) AS n_stray, count_if(t.t IS NULL OR NOT regexp_matches(t.t, '[^\\s\u3000\u00a0]')) AS n_blank, count_if(regexp_matches(t.t, '\\. \\. \\.')) AS n_spaced_dots, count_if(contains(t.t, '--')) AS n_hyphens
    FROM t LEFT JOIN u ON t.work_id = u.work_id AND t.k = u.k GROUP BY t.work_id""")
def overlay_checks(spark, d):
    return Q.overlay_report(table(spark, d, "units"), table(spark, d, "translations"))


@query("overlay_q4_job_check", """
    WITH s AS (SELECT t.tr_id, u.t AS src, t.t AS t FROM translations t JOIN units u ON t.work_id = u.work_id AND t.k = u.k)
    SELECT problem, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(src, '[^\\s\u3000\u00a0]') THEN NULL WHEN t IS NULL OR NOT regexp_matches(t, '[^\\s\u3000\u00a0]') THEN 'missing'
        WHEN regexp_matches(regexp_replace(t, '</?em>|<span class="smallcaps">|</span>', '', 'g'), '<[^>]+>') THEN 'stray markup'
        WHEN len(regexp_extract_all(t, '<em>')) <> len(regexp_extract_all(t, '</em>')) THEN 'unbalanced markup'
        WHEN NOT regexp_matches(t, '[가-힣]') AND length(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '[^A-Za-z]', '', 'g')) > 12
          AND NOT (trim(regexp_replace(regexp_replace(src, '<[^>]+>', '', 'g'), '[\\s“”‘’"]+', ' ', 'g')) = trim(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '[\\s“”‘’"]+', ' ', 'g'))
                   AND NOT regexp_matches(regexp_replace(src, '<[^>]+>', '', 'g'), '(?i)\\b(?:the|and|of|to|is|you|that|with|was|his|her|it|in|for)\\b')) THEN 'untranslated' END AS problem FROM s) GROUP BY problem""")
def job_check(spark, d):
    u = table(spark, d, "units").select("work_id", "k", F.col("t").alias("src"))
    j = table(spark, d, "translations").select("work_id", "k", "t").join(u, ["work_id", "k"])
    return j.groupBy(O.job_problem("src", "t").alias("problem")).agg(F.count("*").alias("n"))


@query("overlay_q5_warnings", """
    SELECT t.work_id, count_if(len(regexp_extract_all(u.t, '<em>')) <> len(regexp_extract_all(t.t, '<em>'))) AS n_emphasis,
      count_if(len(regexp_extract_all(u.t, '[“「]')) > len(regexp_extract_all(t.t, '[“「]'))) AS n_dialogue
    FROM translations t JOIN units u ON t.work_id = u.work_id AND t.k = u.k WHERE t.t IS NOT NULL AND u.t IS NOT NULL GROUP BY t.work_id""")
def style_warnings(spark, d):
    u = table(spark, d, "units").select("work_id", "k", F.col("t").alias("src"))
    j = table(spark, d, "translations").select("work_id", "k", "t").join(u, ["work_id", "k"]).where("t IS NOT NULL AND src IS NOT NULL")
    n = lambda c, p: F.regexp_count(c, F.lit(p))
    return j.groupBy("work_id").agg(F.count_if(n("src", "<em>") != n("t", "<em>")).alias("n_emphasis"), F.count_if(n("src", "[“「]") > n("t", "[“「]")).alias("n_dialogue"))


@query("overlay_u2_import_marks", """
    WITH a AS (SELECT * FROM bookmarks WHERE t = 'mark'), b AS (SELECT mark_id, work_id, p + 1000 AS p FROM bookmarks)
    SELECT mark_id, work_id, p FROM a UNION ALL SELECT mark_id, work_id, p FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.mark_id = b.mark_id)""")
def import_marks(spark, d):
    m = table(spark, d, "bookmarks")
    backup = m.select("mark_id", "work_id", (F.col("p") + 1000).cast("int").alias("p"))
    return S.union_first(m.where("t = 'mark'").select("mark_id", "work_id", "p"), backup, ["mark_id"])


@query("overlay_u3_difference", """
    SELECT DISTINCT k FROM translations WHERE k IS NOT NULL EXCEPT SELECT k FROM units""")
def difference(spark, d):
    return table(spark, d, "translations").where("k IS NOT NULL").select("k").subtract(table(spark, d, "units").select("k"))


@query("overlay_u4_last_writer", """
    SELECT work_id, k, arg_max(t, struct_pack(r := recv_at, i := tr_id)) AS t FROM translations WHERE work_id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL GROUP BY work_id, k""")
def last_writer(spark, d):
    return S.last_writer(table(spark, d, "translations").where("work_id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL"), ["work_id", "k"], "t", ["recv_at", "tr_id"])


@query("overlay_u6_repertoire", """
    SELECT cp FROM (SELECT DISTINCT unicode(c) AS cp FROM (SELECT unnest(string_split(t, '')) AS c FROM units WHERE t IS NOT NULL UNION ALL SELECT unnest(string_split(t, '')) FROM translations WHERE t IS NOT NULL) WHERE c <> '')""")
def repertoire(spark, d):
    one = S.repertoire(table(spark, d, "units"), "t")
    return one.union(S.repertoire(table(spark, d, "translations"), "t")).distinct()


@query("overlay_a17_missing_glyphs", """
    WITH need AS (SELECT DISTINCT unicode(c) AS cp FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL) WHERE c <> ''),
      have AS (SELECT DISTINCT unicode(c) AS cp FROM (SELECT unnest(string_split(t, '')) AS c FROM units WHERE t IS NOT NULL) WHERE c <> '')
    SELECT cp FROM need EXCEPT SELECT cp FROM have""")
def missing_glyphs(spark, d):
    return S.repertoire(table(spark, d, "documents"), "text").subtract(S.repertoire(table(spark, d, "units"), "t"))


@query("overlay_w13_chunks", """
    WITH RECURSIVE u AS (SELECT work_id, seq, coalesce(length(t), 0) AS len, kind = 'h' AS h FROM units),
      f AS (SELECT work_id, seq, 1 AS chunk, CASE WHEN len >= 1500 THEN 0 ELSE len END AS n, CASE WHEN len >= 1500 THEN 2 ELSE 1 END AS nxt FROM u WHERE seq = 0
        UNION ALL
        SELECT u.work_id, u.seq, CASE WHEN u.h AND f.n > 1500 * 0.45 THEN f.nxt + 1 ELSE f.nxt END,
          CASE WHEN (CASE WHEN u.h AND f.n > 1500 * 0.45 THEN 0 ELSE f.n END) + u.len >= 1500 THEN 0 ELSE (CASE WHEN u.h AND f.n > 1500 * 0.45 THEN 0 ELSE f.n END) + u.len END,
          CASE WHEN (CASE WHEN u.h AND f.n > 1500 * 0.45 THEN 0 ELSE f.n END) + u.len >= 1500 THEN CASE WHEN u.h AND f.n > 1500 * 0.45 THEN f.nxt + 2 ELSE f.nxt + 1 END ELSE CASE WHEN u.h AND f.n > 1500 * 0.45 THEN f.nxt + 1 ELSE f.nxt END END
        FROM f JOIN u ON u.work_id = f.work_id AND u.seq = f.seq + 1)
    SELECT work_id, seq, chunk FROM f""")
def chunked(spark, d):
    return O.chunks(table(spark, d, "units"), 1500)


@query("overlay_w12_previous_tail", """
    SELECT work_id, seq, right(regexp_replace(lag(t) OVER (PARTITION BY work_id ORDER BY seq), '<[^>]+>', '', 'g'), 320) AS prev_tail FROM units""")
def previous_tail(spark, d):
    return O.previous_tail(table(spark, d, "units")).select("work_id", "seq", "prev_tail")


@query("overlay_j2_compose_en", "SELECT work_id, seq, 0 AS part, t FROM units")
def compose_en(spark, d):
    return O.compose(table(spark, d, "units"), table(spark, d, "translations"), "en")


@query("overlay_a10_merge_states", """
    WITH a AS (SELECT reader_id, work_id, max(max_frac) AS a FROM progress WHERE lang = 'en' AND reader_id IS NOT NULL AND work_id IS NOT NULL GROUP BY ALL),
      b AS (SELECT reader_id, work_id, max(max_frac) AS b FROM progress WHERE reader_id IS NOT NULL AND work_id IS NOT NULL GROUP BY ALL)
    SELECT coalesce(a.reader_id, b.reader_id) AS reader_id, coalesce(a.work_id, b.work_id) AS work_id, CASE WHEN a.reader_id IS NULL OR coalesce(b > coalesce(a, -1), false) THEN b ELSE a END AS max_frac,
      CASE WHEN a.reader_id IS NULL OR coalesce(b > coalesce(a, -1), false) THEN 'imported' ELSE 'current' END AS origin FROM a FULL JOIN b ON a.reader_id = b.reader_id AND a.work_id = b.work_id""")
def merge_states(spark, d):
    p = table(spark, d, "progress").where("reader_id IS NOT NULL AND work_id IS NOT NULL")
    return O.merge_states(p.where("lang = 'en'"), p)


@query("overlay_u1_unit_stream", "SELECT work_id, seq, kind || ':' || ref AS key, t AS inner_text FROM units WHERE kind IN ('h', 'p')")
def unit_stream(spark, d):
    u = table(spark, d, "units")
    return O.unit_stream(u.where("kind = 'h'"), u.where("kind = 'p'")).withColumnRenamed("inner", "inner_text")


@query("overlay_s11_first_version", """
    SELECT work_id, k FROM units WHERE work_id < 'm' UNION ALL SELECT work_id, k FROM units WHERE work_id >= 'm' AND kind = 'p'""")
def first_version(spark, d):
    u = table(spark, d, "units").select("work_id", "k", "kind")
    return O.first_version(u.where("work_id < 'm'"), u.where("kind = 'p'")).select("work_id", "k")


@query("overlay_s14_one_work", "SELECT seq, t FROM units WHERE work_id = (SELECT min(work_id) FROM units)")
def one_work(spark, d):
    u = table(spark, d, "units")
    first = u.agg(F.min("work_id").alias("work_id"))
    return u.join(first, "work_id", "left_semi").select("seq", "t")


@query("overlay_r2_maps", """
    SELECT work_id, cardinality(map_from_entries(list((k, t)))) AS n, map_from_entries(list((k, t)))['p:0'] AS first_text FROM (
      SELECT work_id, k, arg_max(t, struct_pack(r := coalesce(rev, 0), i := tr_id)) AS t FROM translations WHERE work_id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL GROUP BY work_id, k) GROUP BY work_id""")
def maps(spark, d):
    t = table(spark, d, "translations").where("work_id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL")
    one = t.groupBy("work_id", "k").agg(F.max_by("t", F.struct(F.coalesce("rev", F.lit(0)).alias("r"), "tr_id")).alias("t"))
    # a work's entries are rows and not one map: its size is a count and a lookup a filter, both reduced before they move
    return one.groupBy("work_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("k") == "p:0", F.col("t"))).alias("first_text"))


@query("overlay_w12_previous_items", """
    WITH p AS (SELECT work_id, seq, regexp_replace(t, '<[^>]+>', '', 'g') AS s FROM units WHERE kind = 'p'), m AS (SELECT work_id, seq, CASE WHEN length(s) <= 300 THEN s ELSE substr(s, 1, 148) || ' … ' || right(s, 148) END AS s FROM p)
    SELECT work_id, seq, list_filter([lag(s, 3) OVER w, lag(s, 2) OVER w, lag(s, 1) OVER w], lambda x: x IS NOT NULL) AS prev FROM m WINDOW w AS (PARTITION BY work_id ORDER BY seq)""")
def previous_items(spark, d):
    return O.previous_items(table(spark, d, "units"))
