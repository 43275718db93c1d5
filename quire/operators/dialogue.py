"""Quotations and speech: spans with carry, alignment of speakers, error rates, gated means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from .overlay import newest
from .windows import beside


def openers(df: DataFrame, key: str, text: str) -> DataFrame:
    """The mark that opens most paragraphs of a key; double on a tie."""
    n = lambda c: F.count_if(F.ltrim(text).startswith(c))
    return df.groupBy(key).agg(F.when(n("“") >= n("‘"), "“").otherwise("‘").alias("opener"))


def quotations(units: DataFrame, text: str) -> DataFrame:
    """work_id, seq, s, e, continued of all quotations. A quotation that a paragraph leaves open is carried to the next of its work; a heading ends it.

    What a paragraph leaves open depends on that paragraph alone (functions/quotes), so the carry is the value of the row before, taken in blocks: no
    window and no task holds a work or a chapter. Null texts are passed over.
    """
    x = units.where(F.col(text).isNotNull()).select("work_id", "seq", "kind", text, "lang")
    x = beside(x.withColumn("__open", A.left_open(text, F.col("lang"))), "work_id", "seq", "__open", "__carry")
    carry = F.when(F.coalesce(F.col("kind") != "h", F.lit(True)), F.col("__carry"))
    return x.select("work_id", "seq", F.explode(A.quotations(text, F.col("lang"), carry)).alias("q")).select("work_id", "seq", "q.*")


def counted(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit("[“「]"))


def positional(units: DataFrame, translations: DataFrame) -> DataFrame:
    """unit_id, how, placed: quotations of the text given to those of the translation by place (exact), by the only speaker (same), or not at all (fallback)."""
    u = units.where("t IS NOT NULL").select("unit_id", "work_id", "k", counted("t").alias("n"))
    j = u.join(newest(translations).select("work_id", "k", counted("ko").alias("m")), ["work_id", "k"])
    how = F.when(F.col("n") == F.col("m"), "exact").when(F.col("n") == 1, "same").otherwise("fallback")
    return j.select("unit_id", how.alias("how"), F.when(how != "fallback", F.col("m")).otherwise(0).cast("int").alias("placed"))


def contingency(units: DataFrame, translations: DataFrame) -> DataFrame:
    """how, n_paragraphs, n_quotes over the works."""
    u = units.where("t IS NOT NULL").select("unit_id", counted("t").alias("n"))
    return positional(units, translations).join(u, "unit_id").groupBy("how").agg(F.count("*").alias("n_paragraphs"), F.sum("n").alias("n_quotes"))


def error_rates(df: DataFrame, *by: str) -> DataFrame:
    """Edits over length, summed before they are divided, of df(reference, heard)."""
    edits, n = F.sum(F.levenshtein("reference", "heard")), F.sum(F.length("reference"))
    return df.groupBy(*by).agg(edits.cast("bigint").alias("edits"), n.alias("n"), F.round(edits / F.greatest(n, F.lit(1)), 6).alias("rate"))


def gated_mean(df: DataFrame, key: str, value: str, floor: float, share: float) -> DataFrame:
    """Mean of the values over floor and over share of the mean of those over floor."""
    over = df.where(F.col(value) > floor)
    mean = over.groupBy(key).agg(F.avg(value).alias("__m"))
    return over.join(mean, key).where(F.col(value) > F.col("__m") * share).groupBy(key).agg(F.round(F.avg(value), 6).alias("gated"))


def align_speakers(q: Column, spans: Column) -> Column:
    """Speakers for spans quotations from the script's list q (struct who, how): by place if they are as many, the only speaker for all, else null for each."""
    whos = F.array_distinct(F.transform(q, lambda x: x.who))
    hows = F.array_distinct(F.transform(q, lambda x: x.how))
    none = F.struct(F.lit(None).cast("string").alias("who"), F.lit(None).cast("string").alias("how"))
    one = F.struct(F.element_at(whos, 1).alias("who"), F.when(F.size(hows) == 1, F.element_at(hows, 1)).alias("how"))
    same = (F.size(whos) == 1) & F.element_at(whos, 1).isNotNull()
    plain = F.transform(q, lambda x: F.struct(x.who.alias("who"), x.how.alias("how")))
    return F.when(F.size(q) == spans, plain).when((F.size(q) > 0) & same, F.array_repeat(one, spans)).otherwise(F.array_repeat(none, spans))
