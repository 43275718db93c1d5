"""Constraints as columns: each check is a condition, a report counts where they fail or names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .overlay import stray_markup, unbalanced_markup
from .windows import running


def flags(**checks: Column) -> Column:
    """Names of the conditions that hold, as an array in the order given."""
    return F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))


def overlay_report(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Per work of the overlay: stray keys, blank texts, spaced dots, double hyphens. Rows without a work are left out."""
    u = units.select("work_id", "k", F.lit(1).alias("__u"))
    t = translations.where("work_id IS NOT NULL").select("work_id", "k", "t").join(u, ["work_id", "k"], "left")
    return t.groupBy("work_id").agg(
        F.count_if(F.col("__u").isNull()).alias("n_stray"),
        F.count_if(F.col("t").isNull() | T.blank("t")).alias("n_blank"),
        F.count_if(F.col("t").rlike(r"\. \. \.")).alias("n_spaced_dots"),
        F.count_if(F.col("t").contains("--")).alias("n_hyphens"),
    )


def order_report(units: DataFrame) -> DataFrame:
    """Per work: is seq dense from 0, are keys unique, does no paragraph number go back, does it begin with a heading."""
    p = F.when(F.col("kind") == "p", F.col("ref").try_cast("int"))
    x = running(units.withColumn("p", p), "work_id", "seq", "before", F.col("p"), "max", before=True)
    return x.groupBy("work_id").agg(
        (F.max("seq") == F.count("*") - 1).alias("dense"),
        (F.count_distinct("k") == F.count("*")).alias("unique_keys"),
        F.bool_and(F.coalesce(F.col("p") > F.col("before"), F.lit(True))).alias("in_order"),
        (F.min_by("kind", "seq") == "h").alias("headed"),
    )


def payload_flags(text: Column) -> Column:
    """Faults of a text as it would be shown: foreign tags, unbalanced tags, stray emphasis marks, spaced dots, double hyphens, leftovers of production."""
    return flags(
        stray_tag=stray_markup(text),
        unbalanced=unbalanced_markup(text),
        underscore=text.rlike(r"(^|\s)_\w|\w_(\s|$)"),
        spaced_dots=text.rlike(r"\. \. \."),
        hyphens=text.contains("--"),
        boilerplate=text.rlike(r"(?i)produced by|distributed proofread|all rights reserved"),
    )


#: Wording of imprint pages, looked for in the first 400 characters.
IMPRINT = r"(?i)(electrotyped|macmillan (?:company|and co|& co|co\\.)|scribner(?:['’]s sons| co))"


def payload_problems(df: DataFrame, wrapper: str = "receive(") -> DataFrame:
    """id, problems of payload scripts df(id, js): every condition that a payload misses, in order; no script at all is missing."""
    x = df.select("id", "js", F.from_json(F.regexp_extract("js", r"(?s)\((.*)\)", 1), "id string, chapters array<struct<firstP:int>>, html string").alias("p"))
    repeats = x.where("p.id IS NOT NULL").groupBy(F.col("p.id").alias("__id")).agg(F.count("*").alias("__n"))
    x = x.join(repeats, F.col("p.id") == F.col("__id"), "left")
    html = F.coalesce("p.html", F.lit(""))
    text = T.visible(T.unescape(T.strip_tags(html)))
    n = lambda p: F.regexp_count(html, F.lit(p))
    places = F.transform(F.regexp_extract_all(html, F.lit(r'<p[^>]* data-p="(\d+)"'), 1), lambda i: i.cast("int"))
    firsts = F.transform(F.coalesce("p.chapters", F.array().cast("array<struct<firstP:int>>")), lambda c: c.firstP)
    problems = flags(
        missing=F.col("js").isNull(),
        bad_wrapper=~F.coalesce(F.col("js").startswith(wrapper), F.lit(True)),
        gap_in_places=~(places == F.when(F.size(places) > 0, F.sequence(F.lit(0), F.size(places) - 1)).otherwise(F.array().cast("array<int>"))),
        other_id=F.col("id") != F.col("p.id"),
        repeated_id=F.coalesce("__n", F.lit(0)) > 1,
        sections=n('<section class="ch"') != n("</section>"),
        chapter_out_of_range=F.exists(firsts, lambda i: (i < 0) | (i >= F.size(places))),
        chapters_unordered=firsts != F.array_sort(firsts),
        blockquotes=n("<blockquote[ >]") != n("</blockquote>"),
        divs=n("<div[ >]") != n("</div>"),
        underscore=text.rlike("(?<![A-Za-z0-9])_[A-Za-z]"),
        spaced_dots=text.contains(". . ."),
        hyphens=text.contains("--"),
        boilerplate=text.rlike("Transcriber|Project Gutenberg"),
        imprint=F.substring(text, 1, 400).rlike(IMPRINT),
        short=F.col("js").isNotNull() & (F.length(text) < 400),
    )
    return x.select("id", problems.alias("problems"))


def member_problems(cast: DataFrame, voices: list[str], ages: list[str], genders: list[str]) -> DataFrame:
    """work, id, problems of members (work, id, role, gender, age, names struct, voice struct<base, mix map, speed>).

    A voice (base, mix, speed) held by another narrator or lead of the work is a problem, by a support only a warning.
    """
    mixed = F.aggregate(F.map_values(F.coalesce("voice.mix", F.create_map().cast("map<string,double>"))), F.lit(0.0), lambda a, x: a + x)
    key = F.to_json(F.struct("voice.base", F.array_sort(F.map_entries("voice.mix")).alias("m"), "voice.speed"))
    x = cast.withColumn("__key", key).withColumn("__first", F.min("id").over(Window.partitionBy("work", "__key")))
    x = x.withColumn("__same", F.count("*").over(Window.partitionBy("work", "id")))
    lead = F.col("role").isin("narrator", "lead")
    shared = F.col("__first") != F.col("id")
    problems = flags(
        repeated_id=F.col("__same") > 1,
        bad_role=~F.coalesce(F.col("role").isin("narrator", "lead", "support"), F.lit(False)),
        bad_gender=~F.coalesce(F.col("gender").isin(genders), F.lit(False)),
        bad_age=~F.coalesce(F.col("age").isin(ages), F.lit(False)),
        no_name=F.coalesce(F.col("names.ko"), F.lit("")) == "",
        bad_base=~F.coalesce(F.col("voice.base").isin(voices), F.lit(False)),
        bad_mix=~F.forall(F.coalesce(F.map_keys("voice.mix"), F.array()), lambda k: k.isin(voices)) | (mixed >= 1.0),
        bad_speed=~F.coalesce(F.col("voice.speed").between(0.7, 1.4), F.lit(True)),
        shared_voice=shared & lead,
    )
    return x.select("work", "id", problems.alias("problems"), (shared & ~lead).alias("warn_shared"))


def script_problems(script: DataFrame, members: DataFrame, hows: list[str], moods: list[str], note_max: int = 40) -> DataFrame:
    """work, p, problems of script rows (work, p, n_quotes, q array<struct<who, how, n>>, mood, nar).

    who may be null (the narrator) but must otherwise be a member; the list is as long as there are quotations.
    """
    ids = members.groupBy("work").agg(F.collect_set("id").alias("__ids"))
    x = script.join(ids, "work", "left").withColumn("__ids", F.coalesce("__ids", F.array().cast("array<string>")))
    q = F.coalesce(F.col("q"), F.array().cast(dict(script.dtypes)["q"]))
    problems = flags(
        bad_length=F.size(q) != F.col("n_quotes"),
        unknown_who=F.exists(q, lambda e: e.who.isNotNull() & ~F.array_contains(F.col("__ids"), e.who)),
        bad_how=F.exists(q, lambda e: e.how.isNotNull() & ~e.how.isin(hows)),
        long_note=F.exists(q, lambda e: F.length(e.n) > note_max),
        bad_mood=F.col("mood").isNotNull() & ~F.col("mood").isin(moods),
        unknown_nar=F.col("nar").isNotNull() & ~F.array_contains(F.col("__ids"), F.col("nar")),
    )
    return x.select("work", "p", problems.alias("problems"))


def without_drifted(script: DataFrame, counted: DataFrame) -> DataFrame:
    """Script rows whose quotations have changed in number since lose q and keep mood and nar."""
    c = counted.select("work", "p", F.col("n_quotes").alias("__n"))
    j = script.join(c, ["work", "p"], "left")
    return j.withColumn("q", F.when(F.size("q") == F.coalesce("__n", F.lit(0)), F.col("q"))).drop("__n")
