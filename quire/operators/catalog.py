"""The catalogue of works: classes, facets, reading states, search, sorting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

C = str | Column


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def size_class(minutes: C) -> Column:
    """short under 180 minutes, mid under 480, else long; null minutes are long, as no comparison holds."""
    m = _c(minutes)
    return F.when(m < 180, "short").when(m < 480, "mid").otherwise("long")


def decade(year: C, last: int | None = 1930) -> Column:
    d = (F.floor(_c(year) / 10) * 10).cast("int")
    return d if last is None else F.least(F.lit(last), d)


def facet_filter(works: DataFrame, facets: Mapping[str, Sequence]) -> DataFrame:
    """Rows that pass every facet: a facet passes if the column (or array column) holds any of its values; an empty facet passes all."""
    kinds = dict(works.dtypes)
    out = F.lit(True)
    for column, chosen in facets.items():
        if chosen:
            lit = F.array(*[F.lit(v) for v in chosen])
            out = out & (F.coalesce(F.arrays_overlap(F.col(column), lit), F.lit(False)) if kinds[column].startswith("array") else F.coalesce(F.col(column).isin(list(chosen)), F.lit(False)))
    return works.where(out)


def reading_states(frac: C, finished: C, marks: C) -> Column:
    """All states of a work for a reader, as an array: unread, reading, done, marked. They don't exclude one another."""
    f, done = F.coalesce(_c(frac), F.lit(0.0)), F.coalesce(_c(finished), F.lit(False))
    states = (F.when(~(f > 0.002), "unread"), F.when((f > 0.002) & ~done, "reading"), F.when(done, "done"), F.when(F.coalesce(_c(marks), F.lit(0)) > 0, "marked"))
    return F.array_compact(F.array(*states))


def coverage_states(cov: C) -> Column:
    """ko if anything is translated, kofull from 0.999 on, enonly if nothing is."""
    c = F.coalesce(_c(cov), F.lit(0.0))
    return F.array_compact(F.array(F.when(c > 0, "ko"), F.when(c >= 0.999, "kofull"), F.when(c == 0, "enonly")))


def haystack(works: DataFrame) -> Column:
    """The words by which a work is found, in one lower-case text; missing fields are empty."""
    label = F.create_map(*[F.lit(x) for p in T.FORM_LABEL.items() for x in p])
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    year = F.coalesce(F.col("pub_year").cast("string"), F.lit(""))
    ten = F.coalesce(F.concat(decade("pub_year", None).cast("string"), F.lit("년대")), F.lit(""))
    return F.lower(F.concat_ws(" ", blank("title"), blank("title_ko"), blank("title_orig"), blank("author_ko"), blank("author_en"), blank("author"), year, ten, F.coalesce(F.element_at(label, F.col("form")), F.lit(""))))


def shadow(works: DataFrame) -> Column:
    return T.initials(F.concat_ws(" ", F.coalesce("title_ko", F.lit("")), F.coalesce("author_ko", F.lit(""))))


def search(works: DataFrame, query: str) -> DataFrame:
    return works.where(T.matches(query, haystack(works), shadow(works)))


SORTS = {
    "era": lambda: [F.col("pub_year").asc_nulls_last()],
    "author": lambda: [F.col("author").asc_nulls_last()],
    "title": lambda: [F.col("title").asc_nulls_last()],
    "length": lambda: [F.col("read_minutes").asc_nulls_last()],
    "recent": lambda: [F.col("updated").desc_nulls_last(), F.col("pub_year").asc_nulls_last()],
}


def sort_works(works: DataFrame, mode: str) -> DataFrame:
    """One of five orders; ties keep the order of the catalogue (author, year, title, id)."""
    return works.orderBy(*SORTS[mode](), "author", "pub_year", "title", "work_id")


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def rank_fuzzy(works: DataFrame, query: str, k: int = 40) -> DataFrame:
    """The k works that score best over five fields; those without a complete match are out."""
    score = F.greatest(*[F.coalesce(T.fuzzy_score(query, F.col(c)), F.lit(-1)) for c in ("title", "title_ko", "title_orig", "author_ko", "author_en")])
    return works.withColumn("score", score).where("score >= 0").orderBy(F.desc("score"), "author", "pub_year", "title", "work_id").limit(k)
