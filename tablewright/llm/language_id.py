"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (lower-cased, runs of anything else as one space) are hashed into ``BUCKETS``.
Document frequencies are counted on the cluster over every document that may be learned from. Weights are
trained with follow-the-regularised-leader and an elastic-net penalty, so most stay zero, on about
``TRAIN_ROWS`` documents chosen by a hash of the id, the same number of each language where there are enough. A part of these
is set aside to fit the temperature that makes the scores probabilities.

A null text and a text without a letter are ``und`` with score 0. Repeated rows are predicted alike. Without
anything to learn from, every text is ``und``. An empty table gives an empty result. Input columns named like a
result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append_columns, held_out
from tablewright.llm.words import mix

#: Bound of the sample that the weights and the temperature are fitted on.
TRAIN_ROWS = 4_000
BUCKETS = 1 << 15
MAX_N = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
EPOCHS = 3
CALIBRATION_SHARE = 5
NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngrams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text; empty without a letter."""
    letters = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not letters:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    value = np.zeros(len(points), np.uint64)
    found = []
    for n in range(1, MAX_N + 1):
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
        found.append(mix(value) & np.uint64(BUCKETS - 1))
    return np.concatenate(found).astype(np.int64)


def term_weights(buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their TF-IDF, of length one."""
    counts = np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets = ngrams(text) if text else np.zeros(0, np.int64)
        if not len(buckets) or not self.languages:
            return "und", 0.0
        at, x = term_weights(buckets, self.idf)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal; the last coordinate is the bias, which is not penalised by L1."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))
    l1 = np.full(BUCKETS + 1, L1)
    l1[-1] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        shrunk = np.maximum(np.abs(zs) - l1[at][:, None], 0.0)
        return -np.sign(zs) * shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            at, x = np.r_[at, BUCKETS], np.r_[x, 1.0]
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1.0
            g = x[:, None] * error[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    low, high, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents with each bucket, and documents with any; one row per bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                found = ngrams(t.decode(errors="replace")) if t else ()
                if len(found):
                    seen[:-1] += np.bincount(found, minlength=BUCKETS) > 0
                    seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "docs"])

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket bigint, docs bigint")
    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("docs")).collect():
        out[bucket] = n
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Learn from the documents that are not held out and have a language."""
    known = docs.where(F.col(f"`{lang}`").isNotNull() & ~F.coalesce(held_out(F.col(f"`{key}`")), F.lit(False)))
    known = known.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    sizes = dict(known.groupBy("lang").count().collect())
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    seen, n = document_frequencies(known, "text")
    idf = np.log((1 + n) / (1 + seen)) + 1
    each = rows / len(languages)
    place = F.pmod(F.xxhash64("key", F.lit(10)), F.lit(1_000_000))
    limit = F.create_map(*[F.lit(v) for k in languages for v in (k, int(min(1.0, each / sizes[k]) * 1_000_000))])
    sample = known.where(place < F.element_at(limit, F.col("lang"))).select("lang", "text", F.xxhash64("key", F.lit(11)).alias("place"))

    def make():
        def work(texts):
            made = [term_weights(ngrams(t.decode(errors="replace")) if t else np.zeros(0, np.int64), idf) for t in texts]
            return [[m[0] for m in made], [m[1] for m in made]]

        return work

    code = {k: i for i, k in enumerate(languages)}
    fitted = append_columns(sample, "text", "at array<int>, x array<float>", make).select("lang", "place", "at", "x")
    data = sorted(fitted.where(F.size("at") > 0).collect(), key=lambda r: r["place"])
    examples = [(np.array(r["at"]), np.array(r["x"]), code[r["lang"]]) for r in data]
    spare = [e for i, e in enumerate(examples) if i % CALIBRATION_SHARE == 0]
    weights, bias = follow_the_leader([e for i, e in enumerate(examples) if i % CALIBRATION_SHARE], len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in spare]).reshape(len(spare), len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(logits, np.array([e[2] for e in spare], int)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with ``lang_pred`` and ``score``."""

    def make():
        def work(texts):
            made = [model.predict(t.decode(errors="replace") if t else None) for t in texts]
            return [[m[0] for m in made], [m[1] for m in made]]

        return work

    return append_columns(docs, text, "lang_pred string, score double", make)
