"""Problem 9: the subjects of each document, and the corpus by subject."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table
from .maximized import each_block, maximize
from .subjects import Model, Weights, dealing

#: Labelled rows on which the classifier is fitted, at most, picked by a hash; it is refined over all documents.
LABELLED = 20000


def fit_model(docs: DataFrame, samples: DataFrame, subjects: DataFrame) -> tuple[DataFrame, Model]:
    """Blocks of stems of all documents, and the classifier from them and about LABELLED samples. The subjects are a table that fits on the driver, as their names are the columns of the model."""
    names = sorted(r.subject for r in subjects.where("subject IS NOT NULL AND subject <> 'none'").select("subject").distinct().collect())
    rows = samples.where("subject IS NOT NULL AND text IS NOT NULL").select("subject", "text")
    n = rows.count()
    if n > LABELLED:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 24)) < int(LABELLED / n * (1 << 24)))
    return maximize(spread(docs.select("doc_id", "text", "form")), sorted((r.subject, r.text) for r in rows.collect()), names)


def subject_rows(stored: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject, n_sentences, n_hits, posterior for every subject that some sentence of a document deals with, and deals for those with enough (first: the first such of its document).

    A map over the blocks of maximized.blocks(); the model holds the stems that weigh something. Null and blank texts have no subject.
    """
    shared = stored.sparkSession.sparkContext.broadcast((model.names, Weights.pack(model.keys, model.w), model.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subjects, weights, levels = shared.value
        names = pa.array(subjects, pa.string())
        for batch in batches:
            for b in each_block(batch):
                hits, mean = dealing(Model(subjects, *weights.of(b.stem), levels), b)
                d, j = np.nonzero(hits)
                enough = np.maximum(2, -(-b.sents // 5))
                deals = hits[d, j] >= enough[d]
                order = np.cumsum(deals)
                _, begin = np.unique(d, return_index=True)
                base = np.repeat(order[begin] - deals[begin], np.diff(np.append(begin, len(d)))) if len(d) else order
                kinds = (pa.int64(), None, pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_())
                columns = (b.ids[d], names.take(pa.array(j)), b.sents[d], hits[d, j], np.round(mean[d, j], 6), deals, deals & (order - base == 1))
                yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "subject", "n_sentences", "n_hits", "posterior", "deals", "first"])

    return stored.mapInArrow(run, "doc_id bigint, subject string, n_sentences int, n_hits int, posterior double, deals boolean, first boolean")


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "form")
    return subject_rows(*fit_model(docs, table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "subjects")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).where("deals").select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences by subject, with their shares of all documents; a document of several subjects counts for each, 'none' holds the rest."""
    n = table(spark, sf_dir, "documents").count()
    by = p9_subjects(spark, sf_dir).where("deals").rollup("subject").agg(F.count("*").alias("n_docs"), F.sum("n_hits").alias("n_sentences"), F.count_if("first").alias("n_any"), F.grouping("subject").alias("all"))
    rest = F.col("all") == 1
    docs = F.when(rest, F.lit(n) - F.col("n_any")).otherwise(F.col("n_docs"))
    return by.select(F.when(rest, "none").otherwise(F.col("subject")).alias("subject"), docs.alias("n_docs"), F.when(~rest, F.col("n_sentences")).alias("n_sentences"), F.round(docs / max(n, 1), 6).alias("doc_share"))
