"""Queries that exercise join and lookup shapes, extensions beyond the catalogue included (ext_*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranges as R
from ..sources import table
from .registry import query

CUM = """cum AS (SELECT work_id, seq, coalesce(length(t), 0) AS n, coalesce(sum(coalesce(length(t), 0)) OVER (PARTITION BY work_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
      sum(coalesce(length(t), 0)) OVER (PARTITION BY work_id) AS total FROM units)"""


@query("join_j7_as_of_chapter", """
    WITH h AS (SELECT work_id, seq, t FROM units WHERE kind = 'h')
    SELECT b.mark_id, (SELECT h.t FROM h WHERE h.work_id = b.work_id AND h.seq <= b.p ORDER BY h.seq DESC LIMIT 1) AS chapter FROM bookmarks b""")
def as_of_chapter(spark, d):
    h = table(spark, d, "units").where("kind = 'h'").select("work_id", "seq", "t")
    return R.as_of(table(spark, d, "bookmarks").select("mark_id", "work_id", "p"), h, ["work_id"], "p", "seq", "t", "chapter").select("mark_id", "chapter")


@query("join_j8_locate_fraction", f"""
    WITH {CUM}
    SELECT b.mark_id, (SELECT coalesce(max(c.seq) FILTER (WHERE c.cum < b.frac * c.total), min(c.seq)) FROM cum c WHERE c.work_id = b.work_id) AS pos FROM bookmarks b
    WHERE b.frac IS NOT NULL AND EXISTS (SELECT 1 FROM units u WHERE u.work_id = b.work_id)""")
def locate_fraction(spark, d):
    u = table(spark, d, "units").select("work_id", "seq", F.length("t").alias("n"))
    b = table(spark, d, "bookmarks").where("frac IS NOT NULL").select("mark_id", "work_id", "frac")
    return R.locate(b, u, "work_id", "seq", "n", "frac").select("mark_id", F.col("__at").alias("pos"))


@query("join_j11_title_match", """
    WITH h AS (SELECT unit_id, upper(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) AS key FROM units WHERE kind = 'h' AND t IS NOT NULL),
      w AS (SELECT DISTINCT upper(regexp_replace(orig_term, '[^A-Za-z0-9]', '', 'g')) AS key FROM glossary WHERE lang = 'en')
    SELECT h.unit_id, min(w.key) AS term FROM h JOIN w ON length(w.key) >= 6 AND (starts_with(h.key, w.key) AND length(h.key) - length(w.key) <= 41 OR ends_with(h.key, w.key) AND length(h.key) - length(w.key) <= 25) GROUP BY h.unit_id""")
def title_match(spark, d):
    """Headings that begin or end with a listed term. The list is a small table, broadcast within its size."""
    clean = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    h = table(spark, d, "units").where("kind = 'h' AND t IS NOT NULL").select("unit_id", clean("t").alias("key"))
    terms = table(spark, d, "glossary").where("lang = 'en'").select(clean("orig_term").alias("term")).where(F.length("term") >= 6).distinct()
    # keys that fit share their first or last six characters, so the candidates come from equality joins
    a = h.join(terms.withColumn("x", F.left("term", F.lit(6))), F.left("key", F.lit(6)) == F.col("x")).where(F.col("key").startswith(F.col("term")) & (F.length("key") - F.length("term") <= 41))
    b = h.join(terms.withColumn("x", F.right("term", F.lit(6))), F.right("key", F.lit(6)) == F.col("x")).where(F.col("key").endswith(F.col("term")) & (F.length("key") - F.length("term") <= 25))
    return a.select("unit_id", "term").unionByName(b.select("unit_id", "term")).groupBy("unit_id").agg(F.min("term").alias("term"))


@query("join_j16_manifest_spine", """
    SELECT u.work_id, u.seq, w.title FROM units u JOIN works w ON u.work_id = w.work_id WHERE u.kind = 'h'""")
def manifest_spine(spark, d):
    return table(spark, d, "units").where("kind = 'h'").join(table(spark, d, "works").select("work_id", "title"), "work_id").select("work_id", "seq", "title")


@query("join_j13_count_classes", """
    WITH u AS (SELECT work_id, count(*) AS n FROM units GROUP BY work_id), t AS (SELECT work_id, count(DISTINCT k) AS m FROM translations WHERE work_id IS NOT NULL GROUP BY work_id)
    SELECT class, count(*) AS works, CAST(sum(coalesce(n, 0)) AS BIGINT) AS units FROM (SELECT CASE WHEN m IS NULL THEN 'unscripted' WHEN n IS NULL THEN 'fallback' WHEN n = m THEN 'exact' ELSE 'partial' END AS class, n FROM u FULL JOIN t ON u.work_id = t.work_id) GROUP BY class""")
def count_classes(spark, d):
    u = table(spark, d, "units").groupBy("work_id").agg(F.count("*").alias("n"))
    t = table(spark, d, "translations").where("work_id IS NOT NULL").groupBy("work_id").agg(F.count_distinct("k").alias("m"))
    c = F.when(F.col("m").isNull(), "unscripted").when(F.col("n").isNull(), "fallback").when(F.col("n") == F.col("m"), "exact").otherwise("partial")
    return u.join(t, "work_id", "full").groupBy(c.alias("class")).agg(F.count("*").alias("works"), F.sum(F.coalesce("n", F.lit(0))).alias("units"))


@query("math_m1_fraction", f"""
    WITH {CUM} SELECT b.mark_id, round(least(1, (c.cum + b.o) / greatest(c.total, 1)::DOUBLE), 6) AS frac FROM bookmarks b JOIN cum c ON b.work_id = c.work_id AND b.p = c.seq""")
def fraction(spark, d):
    c = R.cumulative(table(spark, d, "units").select("work_id", "seq", F.length("t").alias("n")), "work_id", "seq", "n")
    j = table(spark, d, "bookmarks").join(c.withColumnRenamed("seq", "p"), ["work_id", "p"])
    return j.select("mark_id", F.round(F.least(F.lit(1.0), (F.col("cum") + F.col("o")) / F.greatest("total", F.lit(1))), 6).alias("frac"))


@query("math_m2_pages", """
    SELECT work_id, CAST(ceil(n_word / 250.0) AS INTEGER) AS pages, CAST(CASE WHEN 0.999 >= 0.999 THEN ceil(n_word / 250.0) ELSE floor(0.5 * n_word / 250.0) + 1 END AS INTEGER) AS last, CAST(floor(0.5 * n_word / 250.0) + 1 AS INTEGER) AS half FROM works WHERE n_word IS NOT NULL""")
def pages(spark, d):
    n = F.ceil(F.col("n_word") / 250.0).cast("int")
    return table(spark, d, "works").where("n_word IS NOT NULL").select("work_id", n.alias("pages"), n.alias("last"), (F.floor(0.5 * F.col("n_word") / 250.0) + 1).cast("int").alias("half"))


@query("math_m3_remaining", "SELECT work_id, CAST(floor(n_char / 5.5 / 200 + 0.5) AS INTEGER) AS minutes FROM works WHERE n_char IS NOT NULL")
def remaining(spark, d):
    return table(spark, d, "works").where("n_char IS NOT NULL").select("work_id", F.floor(F.col("n_char") / 5.5 / 200 + 0.5).cast("int").alias("minutes"))


@query("math_m4_rescale", """
    SELECT b.mark_id, CAST(floor(b.o * length(t.t) / greatest(length(u.t), 1)::DOUBLE + 0.5) AS INTEGER) AS o FROM bookmarks b JOIN units u ON u.work_id = b.work_id AND u.seq = b.p
    JOIN (SELECT work_id, k, arg_max(t, struct_pack(r := coalesce(rev, 0), m := made_at, i := tr_id)) AS t FROM translations WHERE work_id IS NOT NULL AND k IS NOT NULL AND regexp_matches(t, '[^\\s\u3000\u00a0]') GROUP BY work_id, k) t ON t.work_id = u.work_id AND t.k = u.k""")
def rescale(spark, d):
    from ..operators.overlay import newest

    u = table(spark, d, "units").select("work_id", F.col("seq").alias("p"), "k", F.length("t").alias("n"))
    t = newest(table(spark, d, "translations")).select("work_id", "k", F.length("ko").alias("m"))
    j = table(spark, d, "bookmarks").select("mark_id", "work_id", "p", "o").join(u, ["work_id", "p"]).join(t, ["work_id", "k"])
    return j.select("mark_id", F.floor(F.col("o") * F.col("m") / F.greatest("n", F.lit(1)) + 0.5).cast("int").alias("o"))


@query("math_m5_log_width", "SELECT work_id, round(least(44, greatest(18, 10 + 6 * ln(greatest(read_minutes, 1)))), 4) AS width FROM works WHERE read_minutes IS NOT NULL")
def log_width(spark, d):
    return table(spark, d, "works").where("read_minutes IS NOT NULL").select("work_id", F.round(F.least(F.lit(44.0), F.greatest(F.lit(18.0), 10 + 6 * F.ln(F.greatest("read_minutes", F.lit(1))))), 4).alias("width"))


@query("math_m6_buckets", "SELECT unit_id, CAST(ceil(length(t) / CASE WHEN length(t) <= 128 THEN 32.0 WHEN length(t) <= 256 THEN 64.0 ELSE 128.0 END) * CASE WHEN length(t) <= 128 THEN 32 WHEN length(t) <= 256 THEN 64 ELSE 128 END AS INTEGER) AS n FROM units WHERE t IS NOT NULL")
def buckets(spark, d):
    n = F.length("t")
    q = F.when(n <= 128, 32).when(n <= 256, 64).otherwise(128)
    return table(spark, d, "units").where("t IS NOT NULL").select("unit_id", (F.ceil(n / q) * q).cast("int").alias("n"))


@query("math_m8_delivery", "SELECT event_id, round(coalesce(value, 1) * 1.1 * 0.9, 6) AS rate, round(coalesce(value, 0) + 2 - 0.5, 6) AS pitch FROM events")
def delivery(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.coalesce("value", F.lit(1.0)) * 1.1 * 0.9, 6).alias("rate"), F.round(F.coalesce("value", F.lit(0.0)) + 2 - 0.5, 6).alias("pitch"))


@query("math_m9_gain", "SELECT event_id, round(least(0.79, greatest(-3.0, least(3.0, value - 20)) / 10 + 0.5), 6) AS gain FROM events WHERE value IS NOT NULL")
def gain(spark, d):
    v = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("value") - 20))
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", F.round(F.least(F.lit(0.79), v / 10 + 0.5), 6).alias("gain"))


@query("json_r3_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE props IS NOT NULL")
def props(spark, d):
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("array_u5_recents", """
    SELECT reader_id, array_to_string(list_slice(list(work_id ORDER BY u DESC, work_id), 1, 12), ',') AS recent FROM (SELECT reader_id, work_id, max(updated) AS u FROM progress WHERE reader_id IS NOT NULL AND work_id IS NOT NULL AND updated IS NOT NULL GROUP BY reader_id, work_id) GROUP BY reader_id""")
def recents(spark, d):
    p = table(spark, d, "progress").where("reader_id IS NOT NULL AND work_id IS NOT NULL AND updated IS NOT NULL").groupBy("reader_id", "work_id").agg(F.max("updated").alias("u"))
    xs = F.array_sort(F.collect_list(F.struct((-F.col("u")).alias("u"), "work_id")))
    return p.groupBy("reader_id").agg(F.array_join(F.slice(F.transform(xs, lambda x: x.work_id), 1, 12), ",").alias("recent"))


@query("ext_pricing_summary", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_price"), F.count("*").alias("n"))


@query("ext_top_orders", """
    SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey) WHERE n <= 3""")
def top_orders(spark, d):
    j = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice").join(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    w = Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return j.withColumn("n", F.row_number().over(w)).where("n <= 3").select("c_custkey", "o_orderkey")


@query("ext_revenue_by_nation", """
    SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def revenue_by_nation(spark, d):
    # summed by supplier before the joins, so that only one row a supplier is joined
    l = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))  # noqa: E741
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return l.join(s, "s_suppkey").join(n, "n_nationkey").groupBy("n_name", "r_name").agg(F.round(F.sum("x"), 2).alias("revenue"))
