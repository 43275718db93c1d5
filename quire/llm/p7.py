"""Problem 7: documents in containers of a fixed number of tokens.

The histogram of token counts, which has as many bins as a container has tokens, goes to the driver.
Dynamic programming over it chooses the bucket boundaries that minimise padding. Containers form inside
buckets by a token budget: each is anchored in its largest bucket, takes as many items of it as fit, and
its rest is topped up from smaller buckets by a knapsack over the boundaries. (Batches of one bucket alone
leave about a quarter of the space unused here, so the topping up is added to the method.) The recipes
that come of it, at most a few hundred whatever the number of documents, say which ranks of a bucket go
to which containers; ranks are counted inside salted groups of a bucket, so no bucket is one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, shared_dir, spread, table
from .tokens import TOKENIZERS, count

CAPACITY, BUCKETS, GROUP = 1024, 160, 50_000


def sized(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens of df(doc_id, text). Null texts have 0 tokens."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t, tokenizers) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint")


def boundaries(histogram: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most buckets buckets that minimise sum of (end - size) x count; histogram[s] counts the items of size s."""
    sizes = np.flatnonzero(histogram)
    k = len(sizes)
    if k <= buckets:
        return [int(s) for s in sizes]
    n = np.concatenate([[0], np.cumsum(histogram[sizes])]).astype(float)
    total = np.concatenate([[0], np.cumsum(histogram[sizes] * sizes)]).astype(float)
    # cost of one bucket over sizes[i..j]: sizes[j] x items - their sizes
    best = sizes * n[1:] - total[1:]
    back = []
    for _ in range(buckets - 1):
        new, at = np.empty(k), np.empty(k, np.int64)
        for j in range(k):
            c = np.concatenate([[0.0], best[:j]]) + sizes[j] * (n[j + 1] - n[: j + 1]) - (total[j + 1] - total[: j + 1])
            at[j] = int(c.argmin())
            new[j] = c[at[j]]
        best, back = new, [*back, at]
    ends, j = [], k - 1
    for at in reversed(back):
        ends.append(int(sizes[j]))
        j = int(at[j]) - 1
        if j < 0:
            break
    else:
        ends.append(int(sizes[j]))
    return sorted(set(ends))


def recipes(ends: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(containers, [(bucket, items in each)]) until the counts are used up. Each recipe empties a bucket, so there are few."""
    left = list(counts)
    out = []
    while True:
        anchor = max((b for b in range(len(ends)) if left[b]), key=lambda b: ends[b], default=None)
        if anchor is None:
            return out
        recipe: dict[int, int] = {anchor: 1}
        room = capacity - ends[anchor]
        # fullest sum of at most the items there are, larger items first; reach[s]: the bucket that completed sum s
        have = list(left)
        have[anchor] -= 1
        reach: list[tuple[int, int] | None] = [None] * (room + 1)
        reach[0] = (-1, 0)
        for b in sorted(range(len(ends)), key=lambda b: -ends[b]):
            e = ends[b]
            if not have[b] or e > room or reach[room] is not None:
                continue
            used = [0] * (room + 1)
            for s in range(e, room + 1):
                if reach[s] is None and reach[s - e] is not None and used[s - e] < have[b]:
                    used[s] = used[s - e] + 1
                    reach[s] = (b, s - e)
        s = max(s for s in range(room + 1) if reach[s] is not None)
        while s:
            b, s = reach[s]
            recipe[b] = recipe.get(b, 0) + 1
        times = min(left[b] // k for b, k in recipe.items())
        for b, k in recipe.items():
            left[b] -= k * times
        out.append((times, sorted(recipe.items())))


def ranked(items: DataFrame, key: str, groups: Column) -> DataFrame:
    """Adds place, the items' number from 0 within their key, by doc_id and part_no inside salted groups.

    groups says in how many groups the key of a row falls. The salt is a hash of the item, so that no group of
    the window holds a whole key, and the groups' offsets are running sums over their counts, one row a group.
    """
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part_no"), groups))
    offsets = salted.groupBy(key, "salt").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy(key).orderBy("salt")) - F.col("n")).drop("n")
    inner = F.row_number().over(Window.partitionBy(key, "salt").orderBy("doc_id", "part_no")) - 1
    return salted.withColumn("inner", inner).join(offsets, [key, "salt"]).withColumn("place", F.col("base") + F.col("inner")).drop("salt", "base", "inner")


def contained(docs: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, part_no, n_tokens, container_id for df(doc_id, text).

    A document of at most capacity tokens is one item; a longer one is cut into parts of capacity tokens and
    a rest (part_no from 0). Documents without tokens take no space and get no container (null).
    """
    spark = docs.sparkSession
    at = shared_dir(spark, "p7-sizes")
    # counted once, kept outside the executors: the passes below must see the same rows if one is lost
    sized(spread(docs.select("doc_id", "text")), tokenizers).write.parquet(at)
    sizes = spark.read.parquet(at)
    parts = F.expr(f"if(n_tokens > {capacity}, transform(sequence(0, cast(ceil(n_tokens / {capacity}) as int) - 1), i -> struct(i as part_no, least({capacity}, n_tokens - i * {capacity}) as n_tokens)), array(struct(0 as part_no, n_tokens as n_tokens)))")
    items = sizes.select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.part_no", "x.n_tokens")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect():
        histogram[r.n_tokens] = r["count"]
    ends = boundaries(histogram, buckets)
    if not ends:
        return items.withColumn("container_id", F.lit(None).cast("bigint"))
    low = [0, *ends[:-1]]
    counts = [int(histogram[a + 1 : b + 1].sum()) for a, b in zip(low, ends, strict=True)]
    ranges: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    used, base = [0] * len(ends), 0
    for times, recipe in recipes(ends, counts, capacity):
        for b, k in recipe:
            ranges[b].append((used[b], k, base))
            used[b] += k * times
        base += times
    # one row a bucket: its end and, by place, how many items a container takes and the first container
    rows = [(e, [{"lo": lo, "k": k, "base": c} for lo, k, c in r]) for e, r in zip(ends, ranges, strict=True)]
    plan = F.broadcast(spark.createDataFrame(rows, "bucket bigint, ranges array<struct<lo bigint, k bigint, base bigint>>"))
    groups = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for e, c in zip(ends, counts, strict=True) for x in (e, c // GROUP + 1)]), F.col("bucket"))
    bucket = F.array_min(F.filter(F.lit(ends).cast("array<bigint>"), lambda e: e >= F.col("n_tokens")))
    placed = ranked(items.where("n_tokens > 0").withColumn("bucket", bucket), "bucket", groups).join(plan, "bucket")
    r = F.element_at(F.filter("ranges", lambda x: x.lo <= F.col("place")), -1)
    full = placed.withColumn("r", r).select("doc_id", "part_no", "n_tokens", (F.col("r.base") + F.floor((F.col("place") - F.col("r.lo")) / F.col("r.k"))).alias("container_id"))
    return full.unionByName(items.where("n_tokens = 0").withColumn("container_id", F.lit(None).cast("bigint")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their tokens and the share of their space that is used."""
    one = p7_containers(spark, sf_dir).where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    return one.agg(F.count("*").alias("n_containers"), F.sum("k").alias("n_items"), F.sum("n").alias("n_tokens"), F.max("n").alias("most_tokens")).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 6))
