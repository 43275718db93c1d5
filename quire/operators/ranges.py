"""Lookups by range: as-of and prefix-sum bisection, without a theta join over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import running


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, value: str, name: str) -> DataFrame:
    """left with name: the value of the right row of the same keys whose right_on is the last at or before left_on; null if there is none.

    One union and one running value by key, in blocks of the position where it is a number; rows of the right side come first
    at equal positions. Null keys and null positions match none.
    """
    cols = left.columns
    kind = dict(right.dtypes)[value]
    one = F.struct(F.col(value).alias("v"))
    l = left.select(F.struct(*cols).alias("__l"), *keys, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(f"struct<v:{kind}>").alias("__v"))  # noqa: E741
    r = right.where(F.col(right_on).isNotNull()).select(F.lit(None).cast(dict(l.dtypes)["__l"]).alias("__l"), *keys, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), one.alias("__v"))
    x = running(l.unionByName(r), keys, "__at", "__hit", F.col("__v"), "last", tie="__side").where("__side = 1")
    known = F.col("__at").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return x.select("__l.*", F.when(known, F.col("__hit.v")).alias(name))


def cumulative(units: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Adds cum, the characters before each unit, and total, those of all its key. Rows without a key are left out."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    x = running(units.where(F.col(key).isNotNull()), key, order, "cum", n, before=True)
    total = units.groupBy(key).agg(F.sum(n).alias("total"))
    return x.withColumn("cum", F.coalesce("cum", F.lit(0)).cast("bigint")).join(total, key)


def locate(points: DataFrame, units: DataFrame, key: str, order: str, size: str, frac: str) -> DataFrame:
    """points with __at: the order of the unit in which the fraction of the key's characters falls.

    A fraction exactly at a border belongs to the earlier unit; beyond the ends it is clamped. One running value over the
    units' starts and the points, so no point meets all units of its key.
    """
    c = cumulative(units, key, order, size)
    total = c.groupBy(key).agg(F.first("total").alias("__total"), F.max(order).alias("__last"), F.min(order).alias("__first"))
    # from the first character after a unit's end on, the next unit holds the point
    ends = c.select(key, F.col("cum").cast("double").alias("__from"), F.col(order).cast("int").alias("__unit"))
    p = points.join(total, key).withColumn("__goal", F.col(frac) * F.col("__total"))
    a = p.select(key, F.col("__goal").alias("__p"), F.lit(0).alias("__side"), F.struct(*points.columns).alias("__row"), F.lit(None).cast("int").alias("__unit"), "__first")
    b = ends.select(key, F.col("__from").alias("__p"), F.lit(1).alias("__side"), F.lit(None).cast(dict(a.dtypes)["__row"]).alias("__row"), "__unit", F.lit(None).cast("int").alias("__first"))
    hit = running(a.unionByName(b), key, "__p", "__at", F.col("__unit"), "last", tie="__side").where("__row IS NOT NULL")
    return hit.select("__row.*", F.coalesce("__at", "__first").alias("__at"))
