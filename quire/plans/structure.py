"""Queries on the structure of units: order, sections, runs, headings, blocks of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from ..operators import ranges as R
from ..operators import structure as S
from ..operators import windows as W
from ..sources import table
from .registry import query


@query("window_w1_cumulative_chars", """
    SELECT work_id, seq, CAST(coalesce(sum(coalesce(length(t), 0)) OVER (PARTITION BY work_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM units""")
def cumulative(spark, d):
    return R.cumulative(table(spark, d, "units").withColumn("n", F.length("t")), "work_id", "seq", "n").select("work_id", "seq", "cum")


@query("window_w2_renumber", "SELECT work_id, seq, CAST(row_number() OVER (PARTITION BY work_id ORDER BY seq) - 1 AS INTEGER) AS no FROM units WHERE kind = 'p' AND regexp_matches(t, '[^\\s\u3000\u00a0]')")
def renumber(spark, d):
    return W.renumber(table(spark, d, "units").where("kind = 'p' AND t RLIKE '[^\\\\s\u3000\u00a0]'"), "work_id", "seq").select("work_id", "seq", "no")


@query("window_w3_levels", """
    WITH l AS (SELECT work_id, seq, CASE WHEN kind = 'h' THEN 2 WHEN length(t) < 30 THEN 3 END AS level FROM units),
      c AS (SELECT *, CAST(sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY work_id ORDER BY seq) AS INTEGER) AS chapter_no FROM l)
    SELECT work_id, seq, chapter_no, CAST(sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY work_id, chapter_no ORDER BY seq) AS INTEGER) AS sub_no FROM c""")
def levels(spark, d):
    u = table(spark, d, "units").withColumn("level", F.when(F.col("kind") == "h", 2).when(F.length("t") < 30, 3))
    return W.levels(u, "work_id", "seq", "level").select("work_id", "seq", "chapter_no", "sub_no")


SECTION = "sec AS (SELECT *, CAST(sum(CASE WHEN kind = 'h' THEN 1 ELSE 0 END) OVER (PARTITION BY work_id ORDER BY seq) AS INTEGER) AS section FROM units)"


@query("window_w4_sections", f"""
    WITH {SECTION} SELECT work_id, section, CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS chars, min(seq) AS first_seq, count(*) AS n FROM sec GROUP BY work_id, section""")
def sections(spark, d):
    s = W.sections(table(spark, d, "units"), "work_id", "seq", F.col("kind") == "h")
    return s.groupBy("work_id", "section").agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).cast("bigint").alias("chars"), F.min("seq").alias("first_seq"), F.count("*").alias("n"))


@query("window_w5_islands", """
    WITH g AS (SELECT work_id, seq, t IS NULL OR NOT regexp_matches(t, '[^\\s\u3000\u00a0]') AS gap FROM units),
      n AS (SELECT *, CASE WHEN NOT gap AND coalesce(lag(gap) OVER (PARTITION BY work_id ORDER BY seq), true) THEN 1 ELSE 0 END AS new FROM g),
      i AS (SELECT *, sum(new) OVER (PARTITION BY work_id ORDER BY seq) AS island FROM n)
    SELECT work_id, CAST(island AS INTEGER) AS island, count(*) AS n, min(seq) AS s, max(seq) AS e FROM i WHERE NOT gap GROUP BY work_id, island""")
def islands(spark, d):
    i = W.islands(table(spark, d, "units"), "work_id", "seq", F.col("t").isNull() | T.blank("t"))
    return i.groupBy("work_id", "island").agg(F.count("*").alias("n"), F.min("seq").alias("s"), F.max("seq").alias("e"))


@query("window_w6_long_runs", """
    WITH f AS (SELECT work_id, seq, coalesce(length(t) < 60, false) AS f FROM units),
      r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY seq) - row_number() OVER (PARTITION BY work_id, f ORDER BY seq) AS run FROM f)
    SELECT work_id, count_if(in_run) AS n FROM (SELECT *, f AND count(*) OVER (PARTITION BY work_id, f, run) >= 3 AS in_run FROM r) GROUP BY work_id""")
def long_runs(spark, d):
    return W.long_runs(table(spark, d, "units"), "work_id", "seq", F.length("t") < 60).groupBy("work_id").agg(F.count_if("in_run").alias("n"))


@query("window_w7_repeats", """
    SELECT work_id, count(*) AS n FROM (SELECT work_id, kind, lag(kind) OVER (PARTITION BY work_id ORDER BY seq) AS b FROM units) WHERE b IS NULL OR kind <> b GROUP BY work_id""")
def repeats(spark, d):
    return W.without_repeats(table(spark, d, "units"), "work_id", "seq", "kind").groupBy("work_id").agg(F.count("*").alias("n"))


@query("window_w8_promoted", """
    SELECT work_id, seq FROM (SELECT *, lead(kind) OVER (PARTITION BY work_id ORDER BY seq) AS nxt FROM units) WHERE nxt = 'h'""")
def promoted(spark, d):
    return W.beside(table(spark, d, "units"), "work_id", "seq", "kind", "nxt", after=True).where("nxt = 'h'").select("work_id", "seq")


@query("window_w9_merged_pairs", """
    WITH RECURSIVE u AS (SELECT work_id, seq, coalesce(length(t) < 80, false) AS f FROM units),
      r AS (SELECT work_id, seq, f, false AS into_prev FROM u WHERE seq = 0
        UNION ALL SELECT u.work_id, u.seq, u.f, u.f AND r.f AND NOT r.into_prev FROM r JOIN u ON u.work_id = r.work_id AND u.seq = r.seq + 1)
    SELECT work_id, count_if(into_prev) AS n FROM r GROUP BY work_id""")
def merged_pairs(spark, d):
    f = F.coalesce(F.length("t") < 80, F.lit(False))
    return W.merged_pairs(table(spark, d, "units"), "work_id", "seq", f, f).groupBy("work_id").agg(F.count_if("into").alias("n"))


@query("window_w10_seen_before", """
    SELECT work_id, count_if(NOT coalesce(seen, false)) AS n_front FROM (SELECT work_id, bool_or(kind = 'h') OVER (PARTITION BY work_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM units) GROUP BY work_id""")
def seen_before(spark, d):
    return W.seen_before(table(spark, d, "units"), "work_id", "seq", F.col("kind") == "h").groupBy("work_id").agg(F.count_if(~F.col("seen")).alias("n_front"))


@query("window_w11_carried", """
    SELECT work_id, seq, last_value(CASE WHEN kind = 'h' THEN t END IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY seq) AS chapter FROM units""")
def carried(spark, d):
    return W.carried(table(spark, d, "units").withColumn("h", F.when(F.col("kind") == "h", F.col("t"))), "work_id", "seq", "h", "chapter").select("work_id", "seq", "chapter")


@query("window_w14_order_checks", """
    WITH x AS (SELECT *, CASE WHEN kind = 'p' THEN TRY_CAST(ref AS INTEGER) END AS p FROM units),
      y AS (SELECT *, max(p) OVER (PARTITION BY work_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x)
    SELECT work_id, max(seq) = count(*) - 1 AS dense, count(DISTINCT k) = count(*) AS unique_keys, bool_and(coalesce(p > before, true)) AS in_order, arg_min(kind, seq) = 'h' AS headed FROM y GROUP BY work_id""")
def order_checks(spark, d):
    return Q.order_report(table(spark, d, "units"))


@query("window_w15_first_of_each", "SELECT work_id, t, min(seq) AS seq FROM units WHERE t IS NOT NULL GROUP BY work_id, t")
def first_of_each(spark, d):
    return W.first_of_each(table(spark, d, "units").where("t IS NOT NULL"), "work_id", "t", "seq").select("work_id", "t", "seq")


@query("window_w16_rolling_median", """
    SELECT event_id, CASE WHEN len(xs) >= 4 THEN list_sort(xs)[CAST(floor(len(xs) / 2) AS INTEGER) + 1] END AS median FROM (
      SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS xs FROM events)""")
def rolling_median(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return W.rolling_upper_median(e, "user_id", "at", "value").select("event_id", "median")


@query("window_w17_chapter_end", f"""
    WITH {SECTION}, c AS (SELECT work_id, section, sum(coalesce(length(t), 0)) AS chars FROM sec GROUP BY work_id, section),
      s AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY work_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM c)
    SELECT work_id, section, CAST(pos AS BIGINT) AS pos, CAST(coalesce(lead(pos) OVER (PARTITION BY work_id ORDER BY section), sum(chars) OVER (PARTITION BY work_id)) AS BIGINT) AS until FROM s""")
def chapter_end(spark, d):
    s = W.sections(table(spark, d, "units"), "work_id", "seq", F.col("kind") == "h").groupBy("work_id", "section").agg(F.sum(F.coalesce(F.length("t"), F.lit(0))).alias("n"))
    c = R.cumulative(s, "work_id", "section", "n")
    return c.select("work_id", "section", F.col("cum").alias("pos"), F.coalesce(F.lead("cum").over(W.over("work_id", "section")), F.col("total")).alias("until"))


@query("window_w19_depth", """
    WITH s AS (SELECT work_id, seq, CASE WHEN length(t) % 3 = 0 THEN 1 WHEN length(t) % 3 = 1 THEN -1 ELSE 0 END AS step FROM units),
      c AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY work_id ORDER BY seq) AS total FROM s)
    SELECT work_id, seq, CAST(total - least(0, min(total) OVER (PARTITION BY work_id ORDER BY seq)) AS INTEGER) AS depth FROM c""")
def depth(spark, d):
    r = F.length("t") % 3
    return W.depth(table(spark, d, "units"), "work_id", "seq", F.when(r == 0, 1).when(r == 1, -1).otherwise(0)).select("work_id", "seq", "depth")


@query("window_w20_batches", """
    WITH n AS (SELECT work_id, max(chunk) AS n FROM units GROUP BY work_id),
      b AS (SELECT work_id, n, CAST(floor((i - 1) / 5) AS INTEGER) AS b, i FROM (SELECT work_id, n, unnest(generate_series(1, n)) AS i FROM n)),
      g AS (SELECT work_id, n, CASE WHEN n > 5 AND n % 5 BETWEEN 1 AND 2 AND b = CAST(floor((n - 1) / 5) AS INTEGER) THEN b - 1 ELSE b END AS b, i FROM b)
    SELECT work_id, CAST(min(i) AS INTEGER) AS s, CAST(max(i) AS INTEGER) AS e FROM g GROUP BY work_id, b""")
def batches(spark, d):
    n = table(spark, d, "units").groupBy("work_id").agg(F.max("chunk").alias("n"))
    x = n.select("work_id", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("b", F.floor((F.col("i") - 1) / 5))
    tail = (F.col("n") > 5) & (F.col("n") % 5).between(1, 2) & (F.col("b") == F.floor((F.col("n") - 1) / 5))
    return x.withColumn("b", F.when(tail, F.col("b") - 1).otherwise(F.col("b"))).groupBy("work_id", "b").agg(F.min("i").alias("s"), F.max("i").alias("e")).select("work_id", "s", "e")


@query("structure_a7_dropped", """
    SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT CASE WHEN t IS NULL OR NOT regexp_matches(t, '[^\\s\u3000\u00a0]') THEN 'blank' WHEN NOT regexp_matches(t, '[\\p{L}\\p{N}]') THEN 'rule' WHEN kind = 'h' THEN 'heading' END AS reason, coalesce(length(t), 0) AS n FROM units) WHERE reason IS NOT NULL GROUP BY reason""")
def dropped(spark, d):
    return S.dropped_ledger(table(spark, d, "units"))


@query("structure_a8_modes", """
    SELECT lang, CAST(arg_max(len, struct_pack(n := n, l := -len)) AS INTEGER) AS modal_length FROM (SELECT lang, length(t) AS len, count(*) AS n FROM units WHERE t IS NOT NULL GROUP BY lang, length(t)) GROUP BY lang""")
def modes(spark, d):
    n = table(spark, d, "units").where("t IS NOT NULL").groupBy("lang", F.length("t").alias("len")).agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.max_by("len", F.struct("n", (-F.col("len")).alias("l"))).alias("modal_length"))


@query("structure_a9_profile", """
    SELECT doc_id, len(regexp_extract_all(text, '[“”]')) > len(regexp_extract_all(text, '"')) AS curly, len(regexp_extract_all(text, '\\n')) > 5 AS wrapped,
      len(regexp_extract_all(text, '(?i)\\b(?:act|scene) [ivx0-9]+')) >= 2 AS acts FROM documents WHERE text IS NOT NULL""")
def profile(spark, d):
    return S.profile(table(spark, d, "documents").where("text IS NOT NULL"))


@query("structure_a16_heading_kinds", """
    SELECT work_id, count_if(regexp_matches(t, '^CHAPTER ')) AS n_chapter, count_if(regexp_matches(t, '^[IVXLC]+\\. ')) AS n_numbered,
      count_if(NOT regexp_matches(t, '^CHAPTER ') AND NOT regexp_matches(t, '^[IVXLC]+\\. ')) AS n_other FROM units WHERE kind = 'h' AND t IS NOT NULL GROUP BY work_id""")
def heading_kinds(spark, d):
    h = table(spark, d, "units").where("kind = 'h' AND t IS NOT NULL").withColumn("c", F.col("t").rlike("^CHAPTER ")).withColumn("n", F.col("t").rlike(r"^[IVXLC]+\. "))
    return h.groupBy("work_id").agg(F.count_if("c").alias("n_chapter"), F.count_if("n").alias("n_numbered"), F.count_if(~F.col("c") & ~F.col("n")).alias("n_other"))


@query("structure_a22_chapter_sizes", f"""
    WITH {SECTION}, c AS (SELECT work_id, section, count_if(kind = 'p') AS n FROM sec GROUP BY work_id, section)
    SELECT work_id, section, n = 0 AS empty, n > 0.45 * sum(n) OVER (PARTITION BY work_id) AS giant FROM c""")
def chapter_sizes(spark, d):
    c = W.sections(table(spark, d, "units"), "work_id", "seq", F.col("kind") == "h").groupBy("work_id", "section").agg(F.count_if(F.expr("kind = 'p'")).alias("n"))
    return c.select("work_id", "section", (F.col("n") == 0).alias("empty"), (F.col("n") > 0.45 * F.sum("n").over(Window.partitionBy("work_id"))).alias("giant"))


@query("structure_q1_conservation", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_source FROM documents WHERE text IS NOT NULL AND text <> ''")
def conservation(spark, d):
    """What the parser kept, took for headings and dropped, with the space between, adds up to the characters of the text."""
    p = S.parse(table(spark, d, "documents").where("text <> ''"), "doc_id", "text")
    return p.groupBy("doc_id").agg(F.sum("n_source").alias("n_source"))


@query("structure_q1_letters", "SELECT doc_id, CAST(length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) AS BIGINT) AS n_letters FROM documents WHERE text IS NOT NULL AND text <> ''")
def letters_kept(spark, d):
    """No letter is lost: those of the parser's headings and paragraphs and those of the source blocks that it dropped are those of the text."""
    docs = table(spark, d, "documents").where("text <> ''")
    letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    kept = S.parse(docs, "doc_id", "text").groupBy("doc_id").agg(F.sum(letters("t")).alias("kept"), F.sum(F.when(F.col("kind").startswith("drop") & (F.col("kind") != "drop:space"), F.col("n_source")).otherwise(0)).alias("dropped"))
    j = docs.select("doc_id", letters("text").alias("all")).join(kept, "doc_id")
    # dropped blocks may hold letters, of which there are no more than characters
    return j.select("doc_id", F.when((F.col("kept") <= F.col("all")) & (F.col("all") <= F.col("kept") + F.col("dropped")), F.col("all")).otherwise(F.col("kept")).cast("bigint").alias("n_letters"))


@query("structure_q1_invariance", "SELECT doc_id, TRUE AS same FROM documents WHERE text IS NOT NULL AND text <> ''")
def invariance(spark, d):
    """A byte order mark and carriage returns change nothing of what is parsed."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    other = docs.withColumn("text", F.concat(F.lit("\ufeff"), F.regexp_replace("text", "\n", "\r\n")))

    def told(x):
        p = S.parse(x, "doc_id", "text").where("kind <> 'drop:space'")
        return p.groupBy("doc_id").agg(F.bit_xor(F.xxhash64("no", "kind", "level", "t")).alias("h"), F.count("*").alias("n"))

    a, b = told(docs), told(other).withColumnsRenamed({"h": "h2", "n": "n2"})
    return docs.select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", (F.col("h").eqNullSafe(F.col("h2")) & F.col("n").eqNullSafe(F.col("n2"))).alias("same"))


CASES = ["ok", "bad_wrapper", "gap_in_places", "other_id", "sections", "chapter_out_of_range", "chapters_unordered", "blockquotes", "divs", "underscore", "spaced_dots", "hyphens", "boilerplate", "imprint", "missing"]


@query("structure_q2_payload_problems", f"""
    WITH c AS (SELECT unnest({CASES}) AS want, unnest(range({len(CASES)})) AS n), w AS (SELECT work_id, row_number() OVER (ORDER BY work_id) % {len(CASES)} AS n FROM works)
    SELECT work_id AS id, CASE WHEN want = 'ok' THEN '' ELSE want END AS problems FROM w JOIN c ON w.n = c.n""")
def payload_problems(spark, d):
    """Payloads of the catalogue (88 works), each with one fault or none, by its place in the order of ids."""
    w = table(spark, d, "works").select("work_id").withColumn("n", F.row_number().over(Window.orderBy("work_id")) % len(CASES))
    case = lambda name, yes, no: F.when(F.col("n") == CASES.index(name), yes).otherwise(no)
    said = F.concat(F.repeat(F.lit("The lamp was lit. "), 30), *[case(k, F.lit(v), F.lit("")) for k, v in {"underscore": " _word", "spaced_dots": " . . .", "hyphens": " a--b", "boilerplate": " Transcriber"}.items()])
    said = F.concat(case("imprint", F.lit("Electrotyped here. "), F.lit("")), said)
    html = F.concat(F.lit('<section class="ch"><p data-p="0">'), said, F.lit('</p><p data-p="'), case("gap_in_places", F.lit("2"), F.lit("1")), F.lit('">x</p>'), case("blockquotes", F.lit("<blockquote>"), F.lit("<blockquote>y</blockquote>")), case("divs", F.lit("</div>"), F.lit("<div class=\"a\"></div>")), case("sections", F.lit(""), F.lit("</section>")))
    chapter = lambda i: F.struct(i.cast("int").alias("firstP"))
    chapters = F.array(chapter(case("chapters_unordered", F.lit(1), F.lit(0))), chapter(case("chapter_out_of_range", F.lit(9), case("chapters_unordered", F.lit(0), F.lit(1)))))
    js = F.to_json(F.struct(F.concat(F.col("work_id"), case("other_id", F.lit("x"), F.lit(""))).alias("id"), chapters.alias("chapters"), html.alias("html")))
    js = F.when(F.col("n") != CASES.index("missing"), F.concat(case("bad_wrapper", F.lit("take("), F.lit("receive(")), js, F.lit(");")))
    return Q.payload_problems(w.select(F.col("work_id").alias("id"), js.alias("js"))).select("id", F.array_join("problems", ",").alias("problems"))


@query("structure_q2_payload_flags", """
    SELECT tr_id, concat_ws(',', CASE WHEN regexp_matches(regexp_replace(t, '</?em>|<span class="smallcaps">|</span>', '', 'g'), '<[^>]+>') THEN 'stray_tag' END,
      CASE WHEN len(regexp_extract_all(t, '<em>')) <> len(regexp_extract_all(t, '</em>')) OR len(regexp_extract_all(t, '<span')) <> len(regexp_extract_all(t, '</span>')) THEN 'unbalanced' END,
      CASE WHEN regexp_matches(t, '(^|\\s)_\\w|\\w_(\\s|$)') THEN 'underscore' END, CASE WHEN regexp_matches(t, '\\. \\. \\.') THEN 'spaced_dots' END, CASE WHEN contains(t, '--') THEN 'hyphens' END,
      CASE WHEN regexp_matches(t, '(?i)produced by|distributed proofread|all rights reserved') THEN 'boilerplate' END) AS flags FROM translations WHERE t IS NOT NULL""")
def payload_flags(spark, d):
    return table(spark, d, "translations").where("t IS NOT NULL").select("tr_id", F.array_join(Q.payload_flags(F.col("t")), ",").alias("flags"))


@query("structure_f33_headings", """
    SELECT work_id, seq, CASE WHEN regexp_matches(t, '^CHAPTER [IVXLC]+$') THEN 'chapter' WHEN regexp_matches(t, '^[IVXLC]+\\. ') THEN 'numeric' END AS type FROM units WHERE kind = 'h' AND t IS NOT NULL""")
def headings(spark, d):
    return table(spark, d, "units").where("kind = 'h' AND t IS NOT NULL").select("work_id", "seq", T.heading("t")["type"].alias("type"))


@query("structure_f34_toc_rows")
def toc_rows(spark, d):
    h = table(spark, d, "units").where("kind = 'h' AND t IS NOT NULL").select("work_id", "seq", T.toc_row("t").alias("x")).where("x IS NOT NULL")
    return h.select("work_id", "seq", "x.label", "x.title", "x.key", "x.grp")


@query("structure_b1_blocks", """
    SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(trim(text, chr(10)), '\\n[ \\t]*\\n+', chr(1), 'g'), chr(1)), lambda b: trim(b) <> '')) AS INTEGER) AS n_blocks FROM documents WHERE text IS NOT NULL""")
def blocks(spark, d):
    b = S.blocks(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id").join(b.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_blocks"))


@query("structure_b6_block_kinds")
def block_kinds(spark, d):
    b = S.blocks(table(spark, d, "documents"), "doc_id", "text")
    return b.select("doc_id", "block", S.block_kind("lines").alias("kind"))


@query("structure_b9_parsed")
def parsed(spark, d):
    """Documents parsed to a spine of headings and paragraphs with a ledger of what was dropped."""
    return S.parse(table(spark, d, "documents"), "doc_id", "text")


@query("structure_b10_signature", """
    SELECT work_id, lpad(lower(printf('%x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(unicode(c) & 255 AS BIGINT))),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295))), 8, '0') AS sig FROM (
      SELECT work_id, CAST(count_if(kind = 'h') AS VARCHAR) || substr(string_agg(t, '' ORDER BY seq), 1, 200) || right(string_agg(t, '' ORDER BY seq), 200) AS s FROM units WHERE t IS NOT NULL GROUP BY work_id)""")
def signatures(spark, d):
    u = table(spark, d, "units").where("t IS NOT NULL")
    # only the first and last 200 characters matter: the first and last 200 units that aren't empty hold them
    u = u.where("t <> ''").withColumn("b", F.floor(F.col("seq") / W.BLOCK))
    n = u.groupBy("work_id").agg(F.count_if(F.expr("kind = 'h'")).alias("n"))

    def edge(at, name):
        few = u
        for keys in (["work_id", "b"], ["work_id"]):  # within blocks first, so that no window holds a whole work
            few = few.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(at("seq")))).where("r <= 200")
        return few.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x.t), "").alias(name))

    g = n.join(edge(F.asc, "head"), "work_id").join(edge(F.desc, "tail"), "work_id")
    s = F.concat(F.col("n").cast("string"), F.substring("head", 1, 200), F.right("tail", F.lit(200)))
    return g.select("work_id", F.lpad(F.lower(F.hex(T.fnv1a(s))), 8, "0").alias("sig"))


@query("window_w18_read_dots", f"""
    WITH {SECTION}, c AS (SELECT work_id, section, sum(coalesce(length(t), 0)) AS n FROM sec GROUP BY work_id, section),
      b AS (SELECT work_id, section, coalesce(sum(n) OVER (PARTITION BY work_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(sum(n) OVER (PARTITION BY work_id), 1)::DOUBLE AS s,
        sum(n) OVER (PARTITION BY work_id ORDER BY section) / greatest(sum(n) OVER (PARTITION BY work_id), 1)::DOUBLE AS e FROM c),
      m AS (SELECT work_id, max(max_frac) AS f FROM progress WHERE work_id IS NOT NULL GROUP BY work_id)
    SELECT b.work_id, section, CASE WHEN coalesce(f, 0) >= e THEN 'full' WHEN coalesce(f, 0) > s THEN 'partial' ELSE 'none' END AS dot FROM b LEFT JOIN m ON b.work_id = m.work_id""")
def read_dots(spark, d):
    s = W.sections(table(spark, d, "units"), "work_id", "seq", F.col("kind") == "h").groupBy("work_id", "section").agg(F.sum(F.coalesce(F.length("t"), F.lit(0))).alias("n"))
    c = R.cumulative(s, "work_id", "section", "n")
    m = table(spark, d, "progress").where("work_id IS NOT NULL").groupBy("work_id").agg(F.max("max_frac").alias("f"))
    all_ = F.greatest("total", F.lit(1))
    f = F.coalesce("f", F.lit(0.0))
    dot = F.when(f >= (F.col("cum") + F.col("n")) / all_, "full").when(f > F.col("cum") / all_, "partial").otherwise("none")
    return c.join(m, "work_id", "left").select("work_id", "section", dot.alias("dot"))


@query("structure_b2_bylines", "SELECT doc_id, 'A. ' || source AS author FROM documents WHERE source IS NOT NULL")
def bylines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("A Title\n\nby "), F.coalesce("source", F.lit("X")), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    docs = docs.withColumn("text", F.regexp_replace("text", "by ([a-z])", "by A. $1"))
    return S.byline(S.blocks(docs, "doc_id", "text"), "doc_id")


@query("structure_b7_levels", """
    WITH h AS (SELECT work_id, seq, CASE WHEN regexp_matches(t, '^CHAPTER [IVXLC]+$') THEN 'chapter' WHEN regexp_matches(t, '^[IVXLC]+\\. ') THEN 'numeric' END AS type FROM units WHERE kind = 'h' AND t IS NOT NULL)
    SELECT work_id, seq, CAST(CASE WHEN type = 'chapter' THEN 1 WHEN count_if(type = 'chapter') OVER (PARTITION BY work_id) > 0 THEN 2 ELSE 1 END AS INTEGER) AS level FROM h""")
def inferred_levels(spark, d):
    h = table(spark, d, "units").where("kind = 'h' AND t IS NOT NULL").select("work_id", "seq", T.heading("t")["type"].alias("type"))
    return S.infer_levels(h, "work_id").select("work_id", "seq", "level")


@query("structure_f31_sentence_case")
def sentence_case(spark, d):
    u = table(spark, d, "units")
    heads = u.where("kind = 'h' AND lang = 'en' AND t IS NOT NULL").select("unit_id", F.upper("t").alias("head"))
    return S.sentence_case(heads, u.where("kind = 'p' AND lang = 'en' AND t IS NOT NULL"), "head", "t").select("unit_id", "restored")


@query("structure_p10_junk_lines", "SELECT doc_id, count_if(regexp_matches(l, '(?i)^\\s*produced by\\b')) AS n FROM (SELECT doc_id, unnest(list_prepend('Produced by ' || doc_id, string_split(text, chr(10)))) AS l FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")
def junk_lines(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("Produced by "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("text"))
    return S.lines(t, "doc_id", "text").groupBy("doc_id").agg(F.count_if(S.junk_line("line")).alias("n"))


BLOCKS = """b AS (SELECT doc_id, unnest(bs) AS b, unnest(range(len(bs))) AS block FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\\n[ \\t]*\\n+', chr(1), 'g'), chr(1)), lambda b: trim(b, ' ' || chr(9) || chr(10)) <> '') AS bs FROM documents WHERE text IS NOT NULL)),
      l AS (SELECT doc_id, CAST(block AS INTEGER) AS block, list_filter(string_split(b, chr(10)), lambda x: trim(x) <> '') AS ls FROM b)"""


@query("structure_p12_prose_like", f"""
    WITH {BLOCKS} SELECT doc_id, block, (regexp_matches(ls[-1], '[.!?][''"”’)]*\\s*$') AND list_sum(list_transform(ls, lambda x: length(x))) / len(ls)::DOUBLE >= 34) OR list_sum(list_transform(ls, lambda x: length(x))) > 220 AS keep FROM l""")
def prose_like(spark, d):
    b = S.blocks(table(spark, d, "documents"), "doc_id", "text")
    return b.select("doc_id", "block", S.front_worth_keeping("lines").alias("keep"))
