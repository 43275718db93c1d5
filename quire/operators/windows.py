"""Order-dependent operators. Every one names the column that orders its rows.

A key may hold a large part of all rows, so what runs from the first row of a key on is computed in blocks:
a window over each stretch of BLOCK orders, and a window over one row a block that hands on what came before.
No window holds more of a key than a block. That needs a number as order; other orders take one window a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders (sequence numbers) that one window holds.
BLOCK = 65536
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def over(key: str | list[str], order: str | list[str]):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


HOW = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), F.coalesce),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, key: str | list[str], order: str, name: str, value: Column, how: str = "sum", before: bool = False, backward: bool = False, block: int | None = None, tie: str | None = None) -> DataFrame:
    """Adds the running sum, max, min or last value that isn't null of each key up to the row (before: up to the row before it).

    backward runs from the last row of a key to its first. Rows without an order come first. tie orders rows of equal order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    f, join = HOW[how]
    at = F.desc_nulls_last if backward else F.asc_nulls_first
    by = [at(order), *([at(tie)] if tie else [])]
    frame = (Window.unboundedPreceding, -1 if before else 0)
    if dict(df.dtypes)[order] not in NUMBERS:
        return df.withColumn(name, f(value).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(*frame)))
    x = df.withColumn("__b", F.floor(F.col(order) / (block or BLOCK))).withColumn("__v", value)
    inner = x.withColumn("__in", f("__v").over(Window.partitionBy(*keys, "__b").orderBy(*by).rowsBetween(*frame)))
    total = f("__v") if how not in ("last", "first") else (F.min_by if backward else F.max_by)("__v", F.when(F.col("__v").isNotNull(), F.struct(order, *([tie] if tie else []))))
    blocks = x.groupBy(*keys, "__b").agg(total.alias("__t"))
    blocks = blocks.withColumn("__pre", f("__t").over(Window.partitionBy(*keys).orderBy(at("__b")).rowsBetween(Window.unboundedPreceding, -1)))
    right = blocks.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__b").alias("__rb"), "__pre")
    on = F.col("__b").eqNullSafe(F.col("__rb"))
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    return inner.join(right, on, "left").withColumn(name, join(F.col("__in"), F.col("__pre"))).select(*dict.fromkeys([*df.columns, name]))


def beside(df: DataFrame, key: str | list[str], order: str, column: str, name: str, after: bool = False, tie: str | None = None, block: int | None = None) -> DataFrame:
    """Adds the column's value in the row before (or after), null values included; null at the end."""
    x = running(df, key, order, "__beside", F.struct(F.col(column).alias("v")), "last", before=True, backward=after, tie=tie, block=block)
    return x.withColumn(name, F.col("__beside.v")).drop("__beside")


def renumber(df: DataFrame, key: str, order: str, name: str = "no") -> DataFrame:
    """Dense numbers from 0."""
    x = running(df, key, order, "__n", F.lit(1), "sum")
    return x.withColumn(name, (F.col("__n") - 1).cast("int")).drop("__n")


def islands(df: DataFrame, key: str, order: str, gap: Column, name: str = "island") -> DataFrame:
    """Rows that are no gap, numbered by the maximal run without a gap that they are in (from 1)."""
    x = beside(df.withColumn("__gap", F.coalesce(gap, F.lit(True))), key, order, "__gap", "__was")
    new = F.when(~F.col("__gap") & F.coalesce("__was", F.lit(True)), 1).otherwise(0)
    x = running(x, key, order, "__run", new)
    return x.withColumn(name, F.col("__run").cast("int")).where("NOT __gap").drop("__gap", "__was", "__run")


def runs(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Adds __f, the flag, and __run, the number of the run of equal flags."""
    x = beside(df.withColumn("__f", F.coalesce(flag, F.lit(False))), key, order, "__f", "__was")
    return running(x, key, order, "__run", F.when(F.col("__f").eqNullSafe(F.col("__was")), 0).otherwise(1)).drop("__was")


def long_runs(df: DataFrame, key: str, order: str, flag: Column, least: int = 3, name: str = "in_run") -> DataFrame:
    """Marks rows that stand in a run of at least least rows with the flag."""
    x = runs(df, key, order, flag)
    sizes = x.where("__f").groupBy(F.col(key).alias("__k"), F.col("__run").alias("__r")).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    on = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__run") == F.col("__r"))
    return x.join(sizes, on, "left").withColumn(name, F.col("__f") & F.col("__n").isNotNull()).drop("__f", "__run", "__k", "__r", "__n")


def sections(df: DataFrame, key: str, order: str, head: Column, name: str = "section") -> DataFrame:
    """Numbers the stretches that begin at a head; rows before the first are in 0."""
    return running(df, key, order, "__s", F.when(head, 1).otherwise(0)).withColumn(name, F.col("__s").cast("int")).drop("__s")


def levels(df: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """Adds part, chapter and sub numbers of rows with level 1, 2, 3 (null: body); a sub starts anew in each chapter."""
    x = sections(df, key, order, F.col(level) == 1, "part_no")
    x = sections(x, key, order, F.col(level) == 2, "chapter_no")
    return sections(x, [key, "chapter_no"], order, F.col(level) == 3, "sub_no")


def carried(df: DataFrame, key: str, order: str, column: str, name: str) -> DataFrame:
    """The last value that was given, up to and with the row."""
    return running(df, key, order, name, F.col(column), "last")


def seen_before(df: DataFrame, key: str, order: str, flag: Column, name: str = "seen") -> DataFrame:
    """Was the flag set in any earlier row?"""
    return running(df, key, order, "__m", flag.cast("int"), "max", before=True).withColumn(name, F.coalesce("__m", F.lit(0)) == 1).drop("__m")


def first_of_each(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first row of each value, in order; repeats fall away. Rows are reduced on the map side, so no value gathers its rows."""
    rest = [c for c in df.columns if c not in (key, value)]
    return df.groupBy(key, value).agg(F.min_by(F.struct(*rest), order).alias("x")).select(key, value, "x.*").select(*df.columns)


def without_repeats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    x = beside(df, key, order, value, "__before")
    return x.where(~F.col(value).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")


def rolling_upper_median(df: DataFrame, key: str, order: str, value: str, size: int = 6, least: int = 4, name: str = "median", block: int | None = None) -> DataFrame:
    """Upper median of the last size values; null until there are least. Rows are numbered and cut into blocks that lend the next block their last size - 1 rows, so no window holds a whole key."""
    x = renumber(df, key, order, "__no").withColumn("__b", F.floor(F.col("__no") / (block or BLOCK)))
    ends = F.col("__no") % (block or BLOCK) >= (block or BLOCK) - (size - 1)
    x = x.withColumn("__lent", F.explode(F.when(ends, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).withColumn("__b", F.col("__b") + F.col("__lent").cast("int"))
    w = Window.partitionBy(key, "__b").orderBy("__no").rowsBetween(-(size - 1), 0)
    xs = F.array_sort(F.collect_list(value).over(w))
    x = x.withColumn("__xs", xs).where("NOT __lent")
    return x.withColumn(name, F.when(F.size("__xs") >= least, F.element_at("__xs", (F.floor(F.size("__xs") / 2) + 1).cast("int")))).select(*df.columns, name)


def upper_median(value: str | Column) -> Column:
    """Upper median of a group: the element at half, no interpolation. The group's values are gathered, so use it on groups of bounded size."""
    xs = F.array_sort(F.collect_list(value))
    return F.element_at(xs, (F.floor(F.size(xs) / 2) + 1).cast("int"))


def merged_pairs(df: DataFrame, key: str, order: str, first: Column, second: Column, name: str = "into") -> DataFrame:
    """Marks rows that merge into the row before: a second right after a first that hasn't merged itself.

    Pairs don't overlap, so in a run of rows that are both, every other row merges; a row's parity in its run decides.
    """
    x = beside(df.withColumn("__1", F.coalesce(first, F.lit(False))), key, order, "__1", "__was")
    x = x.withColumn("__2", F.coalesce(second & F.col("__was"), F.lit(False)))
    x = running(x, key, order, "__n", F.lit(1))
    # the number of the last row that is no second: the run began after it
    x = running(x, key, order, "__from", F.when(~F.col("__2"), F.col("__n")), "last")
    return x.withColumn(name, F.col("__2") & ((F.col("__n") - F.coalesce("__from", F.lit(0))) % 2 == 1)).drop("__1", "__2", "__was", "__n", "__from")


def depth(df: DataFrame, key: str, order: str, step: Column, name: str = "depth") -> DataFrame:
    """Nesting depth after each row for steps of +1 and -1 that never fall below nought.

    Clamping is undone in closed form: the running sum less the lowest sum so far, where that is negative.
    """
    x = running(df, key, order, "__sum", F.coalesce(step, F.lit(0)))
    x = running(x, key, order, "__low", F.col("__sum"), "min")
    return x.withColumn(name, (F.col("__sum") - F.least(F.lit(0), F.col("__low"))).cast("int")).drop("__sum", "__low")


def batches(n: int, size: int = 5, tail: int = 2) -> list[tuple[int, int]]:
    """Ranges 1..n of size each; a rest of at most tail joins the last."""
    out = [(i, min(n, i + size - 1)) for i in range(1, n + 1, size)]
    if len(out) > 1 and out[-1][1] - out[-1][0] < tail:
        last = out.pop()
        out[-1] = (out[-1][0], last[1])
    return out
