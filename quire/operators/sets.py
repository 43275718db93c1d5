"""Sets and bags of rows, and lists held in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import running


def union_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of first, and those of second whose keys first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def last_writer(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One value a key: that of the row that comes last in order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def repertoire(df: DataFrame, column: str) -> DataFrame:
    """Distinct code points of a text column. Each text is reduced to its own distinct characters before the shuffle."""
    return df.where(F.col(column).isNotNull()).select(F.explode(F.array_distinct(F.split(column, ""))).alias("c")).where("c <> ''").select(F.ascii("c").alias("cp")).distinct()


def to_front(value: Column, recent: Column, most: int = 12) -> Column:
    """The list with value first and nowhere else, at most most long."""
    return F.slice(F.array_distinct(F.concat(F.array(value), F.coalesce(recent, F.array()))), 1, most)


def toggled(xs: Column, value: Column) -> Column:
    """The list without value if it held it, else with it at the end."""
    return F.when(F.array_contains(xs, value), F.array_remove(xs, value)).otherwise(F.array_append(xs, value))


def overlapping(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """row_id, n: rows of the same keys whose stretch [s, e) meets the row's own. Rows that meet no other, and empty stretches, are left out.

    A stretch meets those that start before its end less those that end at or before its start. Both are running counts
    over the distinct places of a key, so no pair is looked at and rows at one place are counted before they move.
    """
    x = df.select(*keys, row_id, "s", "e").where("e > s")
    ends = lambda c, a, b: x.groupBy(*keys, F.col(c).alias("at")).agg(F.count("*").alias("n")).select(*keys, "at", (F.col("n") * a).alias("opens"), (F.col("n") * b).alias("closes"))
    places = ends("s", 1, 0).unionByName(ends("e", 0, 1)).groupBy(*keys, "at").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    places = running(places, keys, "at", "opened", F.col("opens"), before=True)
    places = running(places, keys, "at", "closed", F.col("closes"))
    before = places.select(*keys, F.col("at").alias("e"), F.coalesce("opened", F.lit(0)).alias("opened"))
    gone = places.select(*keys, F.col("at").alias("s"), "closed")
    n = F.col("opened") - F.col("closed") - 1
    return x.join(before, [*keys, "e"]).join(gone, [*keys, "s"]).select(row_id, n.alias("n")).where("n > 0")
