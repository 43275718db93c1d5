"""Problem 8: a mix of documents in which each source has its target share of the tokens.

Documents are soft members of the sources. Those of the labelled table, the documents whose source is
one of the targets, belong to it; for the others a classifier trained on the labelled ones gives
posteriors. Rates, how often each document is used, solve a nonnegative least-squares problem by projected
gradient: every step is one distributed sum of expected tokens by source, and its result, one number a
source, moves every document's rate, which stays between nought and its sources' cap. A rate becomes a whole
number of uses by its fraction against a hash of the document, with one threshold a source and whole part
chosen on a histogram of the hashes so that the tokens come out right.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, spread, stored, table
from .tokens import TOKENIZERS, count
from .truncation import WORDS

#: Labelled documents on which the classifier is fitted, about, picked by a hash and read whole; bits of its features.
SAMPLE, BITS = 6000, 15
#: Steps of the descent at most, after how many the rates are stored, bins of the hash that rounds rates; more targets than MOST_SOURCES are an error.
STEPS, STORED, BINS, MOST_SOURCES = 60, 8, 2048, 1000
#: A miss of this share of the total ends the steps, and so does a square miss that stays above this share of the one before.
NEAR, STALL = 1e-5, 0.98


def bag(text: str) -> list[int]:
    words = [w.lower() for w in WORDS.findall(text)]
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for w in {*words, *(" ".join(p) for p in zip(words, words[1:], strict=False))}]


def fit(rows: list[tuple[str, str]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial naive Bayes over hashed words: log probabilities (sources x features) and log priors."""
    k = {s: i for i, s in enumerate(names)}
    counts = np.full((len(names), 1 << BITS), 0.5)
    prior = np.ones(len(names))
    for s, t in rows:
        if s in k:
            prior[k[s]] += 1
            np.add.at(counts[k[s]], bag(t), 1.0)
    return (np.log(counts) - np.log(counts.sum(1, keepdims=True))).astype(np.float32), np.log(prior / prior.sum())


def members(docs: DataFrame, names: list[str], sample: int = SAMPLE, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, n_tokens, q (membership in each of names, sum 1) of df(doc_id, text, source)."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("source").isin(names) & F.col("text").isNotNull())
    n = max(labelled.count(), 1)
    grid = 1 << 24
    got = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < int(min(1.0, sample / n) * grid) + 1).select("source", F.col("text").alias("t")).collect()
    shared = spark.sparkContext.broadcast((names, *fit(sorted((r.source, r.t) for r in got), names)))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known, w, prior = shared.value
        place = {s: i for i, s in enumerate(known)}
        hard = np.eye(len(known))

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            sizes, q = [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sizes.append(count(t, tokenizers))
                if s in place:
                    q.append(hard[place[s]])
                else:
                    f = bag(t or "")
                    # tempered: the words of a text are no independent witnesses
                    z = prior + (w[:, f].sum(1) / np.sqrt(len(f)) if f else 0.0)
                    p = np.exp(z - z.max())
                    q.append(p / p.sum())
            flat = pa.array(np.concatenate(q) if q else np.empty(0), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * len(known), pa.int32()), flat)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), lists], ["doc_id", "source", "n_tokens", "q"])

        return run

    return map_rows(spread(docs.select("doc_id", "text", "source")), make, "doc_id bigint, source string, n_tokens bigint, q array<double>")


def rates(table_of: DataFrame, shares: np.ndarray, caps: np.ndarray, total: float | None = None, steps: int = STEPS):
    """Column of rates over df(n_tokens, q), and the total that the shares are taken of.

    Without a total, the largest at which every share can be met within the caps.
    """
    k = len(shares)
    cap = F.expr("aggregate(zip_with(q, array(" + ", ".join(f"{float(c)}D" for c in caps) + "), (a, b) -> a * b), 0D, (s, x) -> s + x)")
    by = [F.col("q")[i] for i in range(k)]
    first = table_of.agg(*[F.coalesce(F.sum(F.col("n_tokens") * q), F.lit(0.0)) for q in by], *[F.coalesce(F.sum(F.col("n_tokens") * q * cap), F.lit(0.0)) for q in by]).first()
    have, most = np.array(first[:k], float), np.array(first[k:], float)
    if total is None:
        total = float(min((m / s for m, s in zip(most, shares, strict=True) if s > 0), default=0.0))
    goal = shares * total
    scale = np.maximum(have, 1.0)

    def rate(moves: list[np.ndarray]):
        if not moves:
            return F.least(F.lit(1.0), cap)
        steps_sql = "array(" + ", ".join("array(" + ", ".join(f"{x:.12g}D" for x in m) + ")" for m in moves) + ")"
        dot = "aggregate(zip_with(q, m, (a, b) -> a * b), 0D, (s, x) -> s + x)"
        return F.expr(f"aggregate({steps_sql}, least(1D, __cap), (r, m) -> greatest(0D, least(__cap, r + {dot})))")

    # documents of the same membership share a rate: the descent runs over memberships, few of which are soft
    base = table_of.withColumn("__cap", cap).groupBy("q", "__cap").agg(F.sum("n_tokens").alias("n_tokens"))
    state = stored(base.withColumn("r", F.least(F.lit(1.0), F.col("__cap"))), "p8-members")
    dot = "aggregate(zip_with(q, {m}, (a, b) -> a * b), 0D, (s, x) -> s + x)"
    moves: list[np.ndarray] = []
    before = float("inf")
    for turn in range(steps):
        got = np.array(state.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("r") * F.col("q")[i]), F.lit(0.0)) for i in range(k)]).first(), float)
        miss = goal - got
        # near enough, or at a bound that the caps set
        if np.abs(miss).max() <= NEAR * max(total, 1.0) or np.square(miss).sum() > STALL * before:
            break
        before = float(np.square(miss).sum())
        moves.append(0.9 * miss / scale)
        # one move a step: what a membership needs of the past is its rate
        move = "array(" + ", ".join(f"{x:.12g}D" for x in moves[-1]) + ")"
        state = state.withColumn("r", F.expr(f"greatest(0D, least(__cap, r + {dot.format(m=move)}))"))
        if turn % STORED == STORED - 1:
            state = stored(state, "p8-members")
    return (lambda df: df.withColumn("__cap", cap).withColumn("rate", rate(moves) if moves else F.least(F.lit(1.0), F.col("__cap"))).drop("__cap")), total


def mixed(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate, uses of every document; uses is how often the mix holds it, 0 for not at all.

    targets(source, target_share, max_repeats) is a small table; more than MOST_SOURCES rows are an error.
    Documents without tokens are never used.
    """
    spark = docs.sparkSession
    goal = sorted(targets.where("source IS NOT NULL").select("source", F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("c")).limit(MOST_SOURCES + 1).collect())
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    if not goal:
        return docs.select("doc_id", "source", F.lit(None).cast("bigint").alias("n_tokens"), F.lit(0.0).alias("rate"), F.lit(0).cast("bigint").alias("uses"))
    names = [r.source for r in goal]
    m = stored(members(docs, names), "p8-sizes")
    give, _ = rates(m, np.array([r.s for r in goal], float), np.array([r.c for r in goal], float), total)
    rated = give(m).withColumn("home", F.expr("array_position(q, array_max(q)) - 1")).withColumn("whole", F.floor("rate"))
    rated = rated.withColumn("bin", F.pmod(F.xxhash64("doc_id"), F.lit(BINS))).withColumn("frac", F.col("rate") - F.col("whole"))
    # by source and whole part: the bins whose documents get one use more, in order, until their tokens are what the fractions ask for; at most BINS rows meet in a window
    group = ["home", "whole"]
    bins = rated.groupBy(*group, "bin").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("frac")).alias("want"))
    run = Window.partitionBy(*group).orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(run)).withColumn("want", F.sum("want").over(Window.partitionBy(*group)))
    extra = bins.where(F.col("upto") - F.col("n") / 2 <= F.col("want")).select(*group, "bin", F.lit(1).alias("one"))
    got = rated.join(extra, [*group, "bin"], "left")
    uses = F.when(F.col("n_tokens") > 0, F.col("whole") + F.coalesce("one", F.lit(0))).otherwise(0)
    return got.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), uses.cast("bigint").alias("uses"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the mix by source with their actual share beside the target; documents of no listed source are a row of their own without target."""
    goal = table(spark, sf_dir, "mix_targets")
    mix = p8_mix(spark, sf_dir).where("uses > 0")
    by = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_mixed"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    total = F.sum("n_mixed").over(Window.partitionBy())
    return by.withColumn("actual_share", F.round(F.col("n_mixed") / total, 6)).join(F.broadcast(goal.limit(MOST_SOURCES)), "source", "left").select("source", "n_docs", "n_mixed", "most_uses", "actual_share", "target_share", "max_repeats")
