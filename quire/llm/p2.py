"""Problem 2: pairs of sentences that translate one another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import LENGTHS, Lexicon, Tally, align_all, alignable, lengths_of, lexicon, related, spans, training_pairs
from .common import map_rows, shared_dir, uncollected, values_of
from .langs import korean_share
from .p3 import copied, pairs


def segmented(rows: DataFrame) -> DataFrame:
    """tr_id, unit, text of the rows of df(tr_id, unit, text) that can be aligned, and the starts and ends of the sentences of both by turns (src, tr). A narrow map."""

    def same(u: str, t: str) -> bool:
        return korean_share(t) < 0.6 and copied(u, t)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            kept, left, right = [], [], []
            done: dict[tuple[str | None, str | None], tuple | None] = {}  # what is delivered again has the spans that it had before
            with uncollected():
                for n, (u, t) in enumerate(zip(values_of(b.column(1)), values_of(b.column(2)), strict=True)):
                    if (u, t) not in done:
                        done[u, t] = spans(u, t) if alignable(u, t, same) else None
                    both = done[u, t]
                    if both:
                        x, y = both
                        kept.append(n)
                        left.append(x)
                        right.append(y)
            few = b.take(pa.array(kept, pa.int32()))
            return pa.RecordBatch.from_arrays([*few.columns, turned(left), turned(right)], ["tr_id", "unit", "text", "src", "tr"])

        return run

    return map_rows(rows.select("tr_id", "unit", "text"), make, "tr_id bigint, unit string, text string, src array<int>, tr array<int>")


def turned(spans: list[list[tuple[int, int]]]) -> pa.ListArray:
    """Starts and ends by turns, a list a row."""
    offsets = np.concatenate([[0], np.cumsum([2 * len(x) for x in spans], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int32, offsets[-1])))


def by_twos(x: list[int]) -> list[tuple[int, int]]:
    return list(zip(x[::2], x[1::2], strict=True))


def spans_of(column: pa.ListArray) -> list[list[tuple[int, int]]]:
    """What turned() made the column of."""
    offsets = column.offsets.to_numpy()
    at = offsets[0]
    flat = by_twos(column.values.to_numpy()[at : offsets[-1]].tolist())
    return [flat[a:b] for a, b in pairwise(((offsets - at) // 2).tolist())]


def counted(rows: DataFrame) -> DataFrame:
    """v, w, c: the counts of align.Tally over the rows of segmented() with equally many sentences on both sides, each distinct unit and text once.

    A task counts until its tally is full, then hands the counts on to be summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def out() -> pa.RecordBatch:
            names, v, w, c, lengths = tally.out()
            words = pa.array(names, pa.string())
            left, right, n = (pa.array(x, k) for x, k in zip(zip(*lengths, strict=True) if lengths else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.take(pa.array(v)), left]), pa.concat_arrays([words.take(pa.array(w)), right]), pa.concat_arrays([pa.array(c, pa.int64()), n])], ["v", "w", "c"]
            )

        with uncollected():
            for b in batches:
                for u, t, x, y in zip(*map(values_of, b.columns[:2]), *map(spans_of, b.columns[2:]), strict=True):
                    for p, q in training_pairs(u, t, x, y):
                        tally.add(p, q)
                        if tally.full():
                            yield out()
            yield out()

    # the spans follow from the texts, so this is once each unit and text, by a hash instead of a sort of the texts
    even = rows.where("size(src) = size(tr)").select("unit", "text", "src", "tr").distinct()
    return even.mapInArrow(run, "v string, w string, c bigint").groupBy("v", "w").agg(F.sum("c").alias("c"))


def fit_lexicon(rows: DataFrame) -> Lexicon:
    """From all rows of segmented(). Only the words that may be partners, and the length sums, reach the driver."""
    spark = rows.sparkSession
    at = shared_dir(spark, "p2-counts")
    counted(rows).write.parquet(at)
    counts = spark.read.parquet(at)
    lengths = F.col("v").startswith(LENGTHS)
    n, ratio = lengths_of([tuple(r) for r in counts.where(lengths).select("v", "w", "c").collect()])
    left = counts.where("w = ''").select("v", F.col("c").alias("x"))
    right = counts.where("v = ''").select("w", F.col("c").alias("y"))
    both = counts.where((F.col("v") != "") & (F.col("w") != "") & ~lengths & (F.col("c") >= 2)).join(left, "v").join(right, "w")
    return lexicon((tuple(r) for r in both.where(related(F.col("c"), F.col("x"), F.col("y"), n)).select("v", "w", "c", "x", "y").collect()), n, ratio)


#: Rows that go through the tables of costs together, and characters, so that many rows share a table.
TOGETHER, CHARACTERS = 40_000, 24_000_000


def aligned(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """tr_id, src_start, tr_start of every pair in df(tr_id, unit, text), or in what segmented() makes of it. A narrow map."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon.partners, lexicon.weight, lexicon.ratio))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared.value)
        ids: list[int] = []
        items: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = align_all(items, lex)
            tr = np.repeat(np.array(ids, np.int64), [len(x) for x in found])
            pairs = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int32, 2 * len(tr)).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(tr), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["tr_id", "src_start", "tr_start"])

        with uncollected():
            for b in batches:
                for i, u, t, p, q in zip(*map(values_of, b.columns[:3]), *map(spans_of, b.columns[3:]), strict=True):
                    ids.append(i)
                    items.append((u, t, p, q))
                    size += len(u) + len(t)
                    if len(ids) >= TOGETHER or size >= CHARACTERS:
                        yield out()
                        ids, items, size = [], [], 0
            if ids:
                yield out()

    rows = rows if "src" in rows.columns else segmented(rows)
    return rows.select("tr_id", "unit", "text", "src", "tr").mapInArrow(run, "tr_id bigint, src_start int, tr_start int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph rows only: headings have no sentences to pair. Both sides are segmented once and stored, then counted, then aligned."""
    at = shared_dir(spark, "p2-segmented")
    segmented(pairs(spark, sf_dir).where("NOT heading")).write.parquet(at)
    rows = spark.read.parquet(at)
    return aligned(rows, fit_lexicon(rows))
