"""Expectation-maximization of the subjects' weights over a whole table (problem 9): subjects.fit() in distributed passes.

Documents are turned into numbered stems once, some hundreds to a block, and stored; the rounds and the scoring read the
blocks alone. Each round is one pass: the weights of the round before are broadcast, each document's subjects expected, and
sums of stem by subject added up, in the task first, and written; a second, over stems, turns the sums into weights, of
which only those that aren't 0 reach the driver. Scoring is one more pass over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, shared_dir
from .subjects import LATER, Block, Model, Weights, calibrated, labelled_rows, merged, no_model, number, numbered, sentences, start_weights, stems, sums, weighed

#: Stems whose numbers a task keeps at hand, stems of a block, rows of sums that a task holds before it adds them up, and rows that it hands on at once.
HELD, IN_BLOCK, AT_ONCE, HANDED = 300_000, 300_000, 600_000, 50_000
#: Blocks are few and large: a group of rows is closed by its bytes after every row, as by default Parquet's writer and reader hold a hundred rows or more.
STORED = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of df(doc_id, text, form, label), one a row, as bytes. Texts are whole; null and empty ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([Block.of(held).to_bytes()], pa.binary())], ["block"])

        for batch in batches:
            for i, t, f, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not t:
                    continue
                units = []
                for u in sentences(t, f):
                    own = []
                    for x in stems(u):
                        q = known.get(x)
                        if q is None:
                            q = known[x] = number(x)
                        own.append(q)
                    units.append(own)
                    size += len(own)
                held.append((i, k, units))
                if len(known) >= HELD:
                    known.clear()
                if size >= IN_BLOCK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select("doc_id", "text", "form", "label").mapInArrow(run, "block binary")


def each_block(b: pa.RecordBatch) -> Iterator[Block]:
    for x in b.column("block"):
        yield Block.from_bytes(x.as_buffer())


def scripts(stored: DataFrame) -> DataFrame:
    """s, n: how many documents of each script a block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in each_block(b):
                s, n = np.unique(x.script, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(n, pa.int64())], ["s", "n"])

    return stored.mapInArrow(run, "s int, n bigint")


def handed_on(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch by HANDED rows, as the executor holds what it is given at once."""
    for i in range(0, whole.num_rows, HANDED):
        yield whole.slice(i, HANDED)


def maximize(docs: DataFrame, labelled: list[tuple[str, str]], names: list[str], rounds: int = 8) -> tuple[DataFrame, Model]:
    """The blocks of df(doc_id, text, form), and the model: as subjects.fit(), with all documents as unlabelled ones and the few labelled (subject, text) rows on the driver."""
    spark, n = docs.sparkSession, len(names)
    known = labelled_rows(labelled, names)
    at = shared_dir(spark, "p9-blocks")
    blocks(docs.select("doc_id", "text", "form", F.lit(-1).alias("label"))).write.options(**STORED).parquet(at)
    stored = spark.read.parquet(at)
    if not any(k < n for _, k in known):
        return stored, no_model(names)
    samples = Block.of([(0, k, numbered(t, None)) for t, k in known])
    there = {r.s: r.n for r in scripts(stored).groupBy("s").agg(F.sum("n").alias("n")).collect()}
    start = start_weights(there, dict(zip(*(x.tolist() for x in np.unique(samples.script, return_counts=True)), strict=True)))
    fields = ["id", "seen", "total", *(f"h{j}" for j in range(n))]
    schema = "id bigint, seen bigint, total double, " + ", ".join(f"h{j} double" for j in range(n))
    batch = lambda c: pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 2 else pa.float64()) for i, x in enumerate(c)], fields)
    weights = Weights(n, [], [], [], [], [])
    for turn in range(rounds):
        first = np.maximum(1.0, start * LATER**turn)
        shared = spark.sparkContext.broadcast((weights, first))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts: list[list[np.ndarray]] = []
            known, first = shared.value
            for b in batches:
                for x in each_block(b):
                    parts.append(sums(x, n, *known.of(x.stem), first))
                    if sum(len(p[0]) for p in parts) >= AT_ONCE:
                        parts = [merged(parts)]
                        if len(parts[0][0]) >= AT_ONCE // 2:
                            yield from handed_on(batch(parts.pop()))
            if parts:
                yield from handed_on(batch(merged(parts)))

        own = spark.createDataFrame(pa.Table.from_batches([batch(sums(samples, n, *weights.of(samples.stem), first))]))
        at = shared_dir(spark, f"p9-round-{turn}")
        stored.mapInArrow(run, schema).unionByName(own).groupBy("id").agg(*[F.sum(f).alias(f) for f in fields[1:]]).write.parquet(at)
        table = spark.read.parquet(at)
        whole = np.zeros((3, n + 1))
        for r in table.where("id < 0").collect():
            whole[-1 - r.id] = r[2:]

        def make(whole=whole):
            def weigh(b: pa.RecordBatch) -> pa.RecordBatch:
                c = [np.array(x) for x in b.columns]
                x = weighed(c[0], c[1:], whole)
                kept = np.flatnonzero(x.any(1))
                few = Weights.pack(c[0][kept], x[kept])
                return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in ((few.keys, pa.int64()), (few.j0, pa.int32()), (few.j1, pa.int32()), (few.w0, pa.float64()), (few.w1, pa.float64()))], ["id", "j0", "j1", "w0", "w1"])

            return weigh

        got = map_rows(table.where("id >= 0 AND seen >= 2"), make, "id bigint, j0 int, j1 int, w0 double, w1 double").toArrow().sort_by("id")
        weights = Weights(n, *(got[f].to_numpy() for f in ("id", "j0", "j1", "w0", "w1")))
        shared.unpersist()
    keys, w = weights.of(weights.keys)
    few = F.broadcast(spark.createDataFrame(pa.table({"id": samples.stem})))  # stems of the labelled samples
    sure = table.join(few, "id").toArrow().sort_by("id")
    columns = [sure[f].to_numpy() for f in fields[1:]]
    return stored, Model(names, keys, w, calibrated(samples, n, sure["id"].to_numpy().astype(np.int64), columns, whole, first))
