"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.shared import ASCII_LOWER, Scratch, binary_list, read_table, text_blocks

BUCKETS = 10_000
# Rows of the labelled target sample the target model is fitted on; the raw model counts all documents.
TARGET_ROWS = 20_000
SMOOTHING = 1.0
SEED = 42
MEMO = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, computed once per task while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def gram_counts(text: bytes | None, memo: _Words) -> np.ndarray:
    """Counts of hashed words and word pairs of a whole text."""
    counts, last = np.zeros(BUCKETS, np.int64), np.empty(0, np.uint64)
    for block in text_blocks((text or b"").translate(ASCII_LOWER)):
        h = np.array([memo[w] for w in block.split()], dtype=np.uint64)
        chain = np.concatenate([last, h])
        pairs = (chain[:-1] * _MIX) ^ (chain[1:] + (chain[:-1] >> np.uint64(17)))
        pairs ^= pairs >> np.uint64(31)
        every = np.concatenate([h, pairs]) % np.uint64(BUCKETS)
        counts += np.bincount(every.astype(np.int64), minlength=BUCKETS)
        last = chain[-1:]
    return counts


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``(target, bucket, n)`` from columns ``text, target``: one row per task and bucket, then a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sums = _Words(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(binary_list(batch.column("text")), batch.column("target").to_pylist(), strict=True):
                counts = gram_counts(text, memo)
                sums[0] += counts
                if target:
                    sums[1] += counts
        for kind in (0, 1):
            at = np.flatnonzero(sums[kind])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[kind][at])],
                names=["target", "bucket", "n"],
            )

    parts = docs.mapInArrow(run, "target int, bucket int, n bigint")
    return parts.groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """ln p(bucket | target) - ln p(bucket | raw), add-one smoothed. At most 2 x 10,000 rows come to the driver."""
    sums = np.full((2, BUCKETS), SMOOTHING)
    for row in counts.collect():
        sums[row["target"], row["bucket"]] += row["n"]
    p = sums / sums.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def log_weight(text: Column, ratios: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Words()
        for batch in batches:
            raw = [t.encode() if t else b"" for t in batch]
            yield pd.Series([float(gram_counts(t, memo) @ ratios) for t in raw], dtype="float64")

    return run(text)


def gumbel(*key: Column) -> Column:
    """Gumbel noise from a hash, so a repeated task draws the same."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *key), 11)
    uniform = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, k: int) -> float | None:
    """The k-th largest of column ``key``, by counts in ever finer bins; a pass moves at most 4,096 counts."""
    low, high = values.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    above = 0
    while low < high:
        width = (high - low) / 4096
        if low + width <= low or not math.isfinite(width):
            break
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)).cast("int"), F.lit(4095))
        inside = values.where(F.col("key").between(low, high))
        bins = inside.groupBy(at.alias("bin")).agg(
            F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return high if low >= high else low


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """``doc_id, log_weight, key, selected`` for every row of ``docs`` (``doc_id, text``).

    Target text: rows labelled quality 1. The weight of a text is the ratio of its likelihoods under the hashed
    n-gram models of target and raw text; ``share`` of all rows (by default the share of quality 1 among the labels)
    with the largest log weight + Gumbel noise is selected without replacement. Rows that tie with the last selected
    one are selected as well. Null texts weigh 0. Repeated rows draw the same noise. Without labels of quality 1 all
    weights are 0 and ``share`` defaults to 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality").distinct()
    total, good = known.agg(F.count("*"), F.sum("quality")).first()
    share = share if share is not None else (good / total if good else 1.0)
    target = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    marked = docs.select("doc_id", "text").join(
        F.broadcast(target.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left"
    )
    ratios = log_ratios(corpus_counts(marked.select("text", F.coalesce("target", F.lit(False)).alias("target"))))
    weights = docs.select(
        "doc_id",
        (log_weight(F.col("text"), ratios if good else ratios * 0)).alias("log_weight"),
        gumbel(F.col("doc_id"), F.xxhash64("text")).alias("noise"),
    )
    keyed = scratch.table(weights.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key")), "keys")
    rows = keyed.count()
    cutoff = kth_largest(keyed, round(share * rows))
    selected = F.lit(False) if cutoff is None else F.col("key") >= F.lit(cutoff)
    return keyed.withColumn("selected", selected)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op3_importance_resampling": op3_importance_resampling}
SQL: dict[str, str] = {}
