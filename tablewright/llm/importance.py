"""Quality selection by importance resampling.

Texts are bags of hashed unigrams and bigrams of words and punctuation marks. Two multinomial models are
counted on the cluster, one over the target documents and one over all; a document's log weight is the sum of
log ratios of its n-grams. Resampling without replacement is a top-k of log weight plus Gumbel noise, drawn
from a hash of the id: reruns agree. The k-th largest key is found by counting keys per value range, again and
again inside the range that holds it, so nothing is sorted or collected.

Null and empty texts have log weight 0. Repeated rows draw alike and are taken alike, so equal keys at the
border may take a few rows more than k. Without target documents all weights are 0 and the sample is uniform. An empty table gives
an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import hash_order
from tablewright.llm.common import append_columns
from tablewright.llm.words import PLACES, WORDS_AND_MARKS, hash_words, mix, slices
from tablewright.plans.attach import has_at_most
from tablewright.plans.lineage import cut

BUCKETS = 1 << 14
SMOOTHING = 1.0
DIGITS = 12
RANGES = 2_048
BROADCAST_IDS = 1_000_000


def features(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past-last row, buckets, row of each) per slice."""
    for a, b in slices(texts):
        words, row, _, _ = hash_words(texts[a:b], WORDS_AND_MARKS)
        same = row[1:] == row[:-1]
        pair = mix(words[:-1][same] * PLACES[0] + words[1:][same] * PLACES[1])
        bucket = np.concatenate([words, pair]) & np.uint64(BUCKETS - 1)
        yield a, b, bucket.astype(np.int64), np.concatenate([row, row[:-1][same]])


def count_models(docs: DataFrame, text: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of the documents where ``target`` is true, and of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            wanted = np.array(batch.column(1).to_pylist(), bool)
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for a, _, bucket, row in features(texts):
                seen[1] += np.bincount(bucket, minlength=BUCKETS)
                seen[0] += np.bincount(bucket[wanted[a + row]], minlength=BUCKETS)
        at = np.flatnonzero(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], ["bucket", "wanted", "every"])

    counted = docs.select(F.col(f"`{text}`"), F.col(f"`{target}`")).mapInArrow(run, "bucket bigint, wanted bigint, every bigint")
    out = np.zeros((2, BUCKETS), np.int64)
    for bucket, wanted, every in counted.groupBy("bucket").agg(F.sum("wanted"), F.sum("every")).collect():
        out[:, bucket] = wanted, every
    return out[0], out[1]


def log_ratio(wanted: np.ndarray, every: np.ndarray) -> np.ndarray:
    if not wanted.sum():
        return np.zeros(BUCKETS)
    p, q = wanted + SMOOTHING, every + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def with_log_weight(docs: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    def make():
        def work(texts):
            out = np.zeros(len(texts))
            for a, b, bucket, row in features(texts):
                out[a:b] = np.bincount(row, ratio[bucket], b - a)
            return [out]

        return work

    return append_columns(docs, text, "log_weight double", make)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """Exact, by counting ranges of values; ``keys`` is read once per round. Minus infinity if there are no more than k."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k or n == 0:
        return float("-inf")
    left = k
    inside = keys.where(F.col(column).isNotNull())
    while low < high:
        width = (high - low) / RANGES
        cell = F.least(F.lit(RANGES - 1), F.floor((F.col(column) - low) / width)).cast("int") if width > 0 else F.lit(0)
        part = inside.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(cell.alias("cell"))
        rows = sorted(part.agg(F.count("*"), F.min(column), F.max(column)).collect(), reverse=True)
        for _, count, least, most in rows:
            if left <= count:
                low, high = least, most
                break
            left -= count
    return high


def resample(
    docs: DataFrame, target_ids: DataFrame, text: str = "text", key: str = "doc_id", share: float = 0.5, seed: int = 4
) -> DataFrame:
    """(key, log_weight, sample_key, kept): the ``share`` of the documents that are drawn as ``kept``."""
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_body"))
    ids = cut(target_ids.select(F.col(f"`{key}`")).where(F.col(f"`{key}`").isNotNull()).distinct().withColumn("_wanted", F.lit(True)))
    side = F.broadcast(ids) if has_at_most(ids, BROADCAST_IDS) else ids
    flagged = rows.join(side, key, "left").withColumn("_wanted", F.coalesce("_wanted", F.lit(False)))
    ratio = log_ratio(*count_models(flagged, "_body", "_wanted"))
    u = (F.conv(F.substring(hash_order([key], seed), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    weighed = with_log_weight(rows, ratio, "_body").drop("_body").withColumn("sample_key", F.col("log_weight") - F.log(-F.log(u)))
    weighed = cut(weighed)
    border = kth_largest(weighed, "sample_key", int(round(share * weighed.count())))
    return weighed.withColumn("kept", F.col("sample_key") >= border)
