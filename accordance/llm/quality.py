"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features of a text are the hashes of its words, word pairs, and pairs and triples of word
shapes (case, digits, marks, length, whether a word repeats the one before it). A feature's
value is its share of the text's features, scaled; a score is the logistic function of a
sparse dot product, which numpy forms for a block of texts at once by one gather and one
weighted count. Weights are learned by follow-the-regularised-leader updates, one text at a
time, over ``EPOCHS`` passes.

Training reads at most about ``SAMPLE`` labelled rows, chosen by a hash of doc_id (a
documented bound). The weights (``DIMS`` floats) are broadcast; scoring is one pass without
a shuffle.

Defined cases: a null or empty text has no features and gets the intercept's score; null
labels aren't learned from; of several labels of a document the smallest counts; without
any label every score is 0.5; an empty table gives an empty table; repeated rows are scored
alike; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import SPACE, importable, mix64, plus, prefix_hashes, substring_hashes, text_buffers, word_bounds

DIMS_LOG, SAMPLE, EPOCHS, SCALE = 18, 6000, 3, 30.0
DIMS = 1 << DIMS_LOG
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-3
#: Bits of a byte's class: lower, upper, digit, mark, beyond ASCII.
_BITS = np.full(256, 8, np.uint8)
_BITS[97:123], _BITS[65:91], _BITS[48:58], _BITS[128:] = 1, 2, 4, 16
_BITS[SPACE] = 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every occurrence in a block of texts."""
    starts, stops, row = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = substring_hashes(prefix_hashes(data), starts, stops)
    bits = np.bitwise_or.reduceat(_BITS[data], starts).astype(np.uint64)
    shape = bits | (_BITS[data[starts]].astype(np.uint64) << np.uint64(5)) | (_BITS[data[stops - 1]].astype(np.uint64) << np.uint64(10)) | (np.minimum(stops - starts, 24).astype(np.uint64) // np.uint64(4) << np.uint64(15))
    together = row[1:] == row[:-1]
    same = np.zeros(len(word), np.uint64)
    same[1:] = (word[1:] == word[:-1]) & together
    shape |= same << np.uint64(20)
    salt = lambda x, k: mix64(x * np.uint64(2 * k + 1) + np.uint64(k << 40))
    s = salt(shape, 3)
    found = [(row, salt(word, 1)), (row[1:][together], mix64(word[:-1] * np.uint64(3) + word[1:])[together]), (row, salt(shape, 5)), (row[1:][together], mix64(s[:-1] * np.uint64(5) + s[1:])[together])]
    if len(word) > 2:
        three = together[1:] & together[:-1]
        found.append((row[2:][three], mix64(s[:-2] * np.uint64(25) + s[1:-1] * np.uint64(7) + s[2:])[three]))
    return np.concatenate([r for r, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - DIMS_LOG)).astype(np.int64)


class Model:
    """Weights and intercept."""

    def __init__(self):
        self.weights, self.intercept = np.zeros(DIMS), 0.0

    def fit(self, texts: pa.Array, labels: list[int], epochs: int = EPOCHS) -> Model:
        """FTRL-proximal: each coordinate keeps z and the sum of squared gradients n."""
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b, data, off in text_buffers(texts, 1 << 20):
            row, h = features(data, off)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(b - a + 1))
            for i in range(b - a):
                at, n = np.unique(h[order[cuts[i] : cuts[i + 1]]], return_counts=True)
                rows.append((np.append(at, DIMS), np.append(n * (SCALE / max(n.sum(), 1)), 1.0)))
        z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
        weight = lambda zi, ni: -np.sign(zi) * np.maximum(np.abs(zi) - L1, 0) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        for _ in range(epochs):
            for (at, x), y in zip(rows, labels, strict=True):
                zi, ni = z[at], n[at]
                w = weight(zi, ni)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - y) * x
                z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[at] = ni + g * g
        w = weight(z, n)
        self.weights, self.intercept = w[:DIMS].astype(np.float32), float(w[DIMS])
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        row, h = features(data, offsets)
        dot = np.bincount(row, self.weights[h], rows) * (SCALE / np.maximum(np.bincount(row, minlength=rows), 1)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns ``label`` from at most about ``sample`` labelled rows."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, sample / max(n, 1)) * (1 << 20))
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").withColumn("at", F.xxhash64(F.lit(5), "doc_id")).orderBy("at", "text").select("text", "y").toArrow()
    return Model().fit(rows["text"].combine_chunks(), rows["y"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score."""
    importable(docs.sparkSession)
    base = docs.drop("score")
    names, sent = base.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.score(data, off) for _, _, data, off in text_buffers(batch.column(names.index("text")), 1 << 19)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], [*names, "score"])

    return base.mapInArrow(run, plus(base.schema, score="double"))
