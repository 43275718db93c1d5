"""Texts carried over from one version of a document's units to the next, without a matcher over whole documents."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .windows import beside, renumber, running


def heaviest_chain(first: list[int], second: list[int], weight: list[int]) -> list[int]:
    """Places of the chain that increases in both numbers and weighs most; first is in order. Of equal chains the one that ends earliest."""
    order = sorted(set(second))
    size = len(order)
    tree: list[tuple[int, int]] = [(0, -1)] * (size + 1)
    back = []
    for at, (s, w) in enumerate(zip(second, weight, strict=True)):
        p = bisect_left(order, s)
        best, q = (0, -1), p
        while q:
            best = max(best, tree[q], key=lambda x: x[0])
            q &= q - 1
        back.append(best[1])
        here, q = (best[0] + w, at), p + 1
        while q <= size:
            if here[0] > tree[q][0]:
                tree[q] = here
            q += q & -q
    top, q = (0, -1), size
    while q:
        top = max(top, tree[q], key=lambda x: x[0])
        q &= q - 1
    out, at = [], top[1]
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def unmoved(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df(keys, i, j) on the longest chain that increases in both i and j.

    A pair goes on the run of the pair before it by i if that is the pair before it by j too, so a document is a few such
    runs, one more for every stretch that moved; only the runs, one row each, meet in a task. Every running value joins
    its own input again, hence the stored steps.
    """
    x = stored(pairs.withColumn("__me", F.struct("i", "j")))
    x = stored(beside(x, keys, "i", "__me", "__by_i"))
    x = stored(beside(x, keys, "j", "__me", "__by_j"))
    x = stored(running(x, keys, "i", "__run", F.when(F.col("__by_i").eqNullSafe(F.col("__by_j")), 0).otherwise(1)))
    runs = x.groupBy(*keys, "__run").agg(F.min("i").alias("a"), F.min("j").alias("b"), F.count("*").alias("n"))
    schema = ", ".join(f"{k} {t}" for k, t in runs.dtypes if k in (*keys, "__run"))

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("a")
        return p.iloc[heaviest_chain(list(p.a), list(p.b), list(p.n))][[*keys, "__run"]]

    # a single run needs no choice
    per = runs.groupBy(*keys).agg(F.count("*").alias("m"))
    chosen = runs.join(per.where("m > 1"), keys, "left_semi").groupBy(*keys).applyInPandas(choose, schema)
    chosen = chosen.unionByName(runs.join(per.where("m = 1"), keys, "left_semi").select(*keys, "__run"))
    return x.join(chosen, [*keys, "__run"], "left_semi").select(*keys, "i", "j")


def _split(side: DataFrame, found: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The rows of a side that have no partner, with the number of partners before them as name."""
    x = side.join(found.select(*keys, F.col(order).alias("at"), F.lit(1).alias("__hit")), [*keys, "at"], "left")
    x = running(x, keys, "at", name, F.coalesce("__hit", F.lit(0)))
    return x.where("__hit IS NULL").drop("__hit")


def paired(old: DataFrame, new: DataFrame, key: str = "work_id") -> DataFrame:
    """key, i, j: the places of a new version's units and of the old ones that they go back to, of df(key, at, form).

    Forms that stand once in either version are anchors; of those the longest chain in order is taken. Between two
    anchors, the n-th of equal forms are taken in the same way. What is left between two partners goes by place if both sides
    hold equally many; the rest of a document, in order, by place too. All of it is joins and numbers: a document may
    be of any length. Null forms have no equal.
    """

    def once(side: DataFrame, order: str) -> DataFrame:
        return side.where("form IS NOT NULL").groupBy(key, "form").agg(F.count("*").alias("n"), F.min("at").alias(order)).where("n = 1").drop("n")

    old, new = stored(old), stored(new)
    first = unmoved(once(old, "i").join(once(new, "j"), [key, "form"]).select(key, "i", "j"), [key])
    first = stored(first)
    a, b = stored(_split(old, first, [key], "i", "gap")), stored(_split(new, first, [key], "j", "gap"))
    gap = [key, "gap"]
    nth = lambda side, order: renumber(side.where("form IS NOT NULL"), [*gap, "form"], "at", "nth").select(*gap, "form", "nth", F.col("at").alias(order))
    second = unmoved(nth(a, "i").join(nth(b, "j"), [*gap, "form", "nth"]).select(*gap, "i", "j"), gap)
    second = stored(second)
    a, b = stored(_split(a, second, gap, "i", "inner")), stored(_split(b, second, gap, "j", "inner"))
    spot = [*gap, "inner"]
    sizes = lambda side, name: side.groupBy(*spot).agg(F.count("*").alias(name))
    even = sizes(a, "na").join(sizes(b, "nb"), spot).where("na = nb").select(*spot, F.lit(True).alias("even"))

    def by_place(side: DataFrame, keys: list[str], order: str) -> DataFrame:
        return renumber(side, keys, "at", "nth").select(*keys, "nth", F.col("at").alias(order))

    a, b = stored(a.join(even, spot, "left")), stored(b.join(even, spot, "left"))
    same = by_place(a.where("even"), spot, "i").join(by_place(b.where("even"), spot, "j"), [*spot, "nth"])
    rest = by_place(a.where("even IS NULL"), [key], "i").join(by_place(b.where("even IS NULL"), [key], "j"), [key, "nth"])
    out = [x.select(key, "i", "j") for x in (first, second, same, rest)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
