"""Language identification by nearest centroids.

A text is a TF-IDF vector of hashed byte bigrams and trigrams (letters in lower case, all
else a space), of length 1. Each language has up to ``CENTROIDS`` centroids, found by
spherical k-means on its training texts; a text gets the language of the centroid with the
greatest cosine, which is its score. A text is rejected if its cosine lies under the
bound of that language for its length in bytes: ``SLACK`` of the ``LOW`` quantile of the
cosines that the language's own training texts have when cut to the greatest of ``LENGTHS``
that fits. So one odd training text doesn't widen the bound, and short clean texts, whose
cosines are small, aren't held to that of long ones; below the least length nothing is
rejected by distance. With fewer than ``ENOUGH`` training texts of a length a language keeps
its bound of the length before, at first a margin under the least cosine of any text. N-grams of spaces only say
nothing of a language and aren't counted.

Training reads at most about ``PER_LANG`` texts of a language, chosen by a hash of doc_id
(a documented bound; counts of the languages come from all rows). The model (a few centroids
of ``DIMS`` floats) is broadcast; scoring is one pass of ``mapInArrow`` without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected;
rows without lang aren't learned from; equal cosines go to the language that sorts first;
without any training row every text is ``und``; an empty table gives an empty table;
repeated rows are scored alike; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import importable, plus, text_buffers

DIMS_LOG, CENTROIDS, PER_LANG, MARGIN = 13, 4, 500, 0.8
DIMS = 1 << DIMS_LOG
LENGTHS, LOW, SLACK, ENOUGH = (8, 16, 32, 64, 128, 256, 512, 1024), 0.05, 0.4, 30
#: Letters stay; every other ASCII byte is a space.
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: its counts of hashed bigrams and trigrams."""
    rows = len(offsets) - 1
    out = np.zeros(rows * DIMS, np.float32)
    if len(data):
        code, row = _CLASS[data], np.repeat(np.arange(rows), np.diff(offsets))
        mixed, letter = [code * m for m in _MUL], code != 32
        for n in (2, 3):
            if len(data) >= n:
                size = len(data) - n + 1
                h = mixed[0][:size] ^ np.uint32(n)
                for i in range(1, n):
                    h = h + (mixed[i][i : i + size] ^ (mixed[i][i : i + size] >> np.uint32(15)))
                h = (h ^ (h >> np.uint32(13))) * _MUL[1]
                inside = (row[:size] == row[n - 1 :]) & np.logical_or.reduce([letter[i : i + size] for i in range(n)])
                out += np.bincount((row[:size] * DIMS + (h >> np.uint32(32 - DIMS_LOG)))[inside], minlength=rows * DIMS)
    return out.reshape(rows, DIMS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def matrix(texts: pa.Array) -> np.ndarray:
    """log(1 + count) for all texts of a small column."""
    lower = pc.utf8_lower(texts)
    return np.concatenate([np.log1p(counts(data, off)) for _, _, data, off in text_buffers(lower, 1 << 20, 128)] or [np.zeros((0, DIMS), np.float32)])


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from farthest-first starts; deterministic."""
    centres = unit(x.mean(0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(1))]])
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        centres = unit(np.vstack([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))]))
    return centres


class Model:
    """Centroids of each language over TF-IDF vectors."""

    def __init__(self, texts: pa.Array, langs: list[str], k: int = CENTROIDS):
        x = matrix(texts)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        x = unit(x * self.idf)
        self.names, parts = [], []
        for name in sorted(set(langs)):
            own = k_means(x[[i for i, v in enumerate(langs) if v == name]], k)
            self.names += [name] * len(own)
            parts.append(own)
        self.centres = np.vstack(parts).astype(np.float32) if parts else np.zeros((0, DIMS), np.float32)
        best = (x @ self.centres.T).max(1) if parts and len(x) else np.ones(1)
        self.least = float(best.min()) * (1 - MARGIN)
        self.bounds = np.zeros((len(self.names), len(LENGTHS) + 1))
        kinds, sizes = np.array(langs, object), pc.binary_length(pc.utf8_lower(texts)).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0)
        for at, length in enumerate(LENGTHS, 1):
            long = np.flatnonzero(sizes >= length)
            cut = [t.encode()[:length].decode("utf-8", "ignore") for t in pc.utf8_lower(texts.take(pa.array(long))).to_pylist()]
            cosines = unit(matrix(pa.array(cut, pa.string())) * self.idf) @ self.centres.T
            for name in sorted(set(langs)):
                mine = [i for i, v in enumerate(self.names) if v == name]
                own = cosines[kinds[long] == name][:, mine].max(1, initial=0)
                self.bounds[mine, at] = SLACK * np.quantile(own, LOW) if len(own) >= ENOUGH else self.bounds[mine, at - 1] if at > 1 else self.least

    def bound(self, near: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The least cosine that isn't rejected, for each text's nearest centroid and length in bytes."""
        return self.bounds[near, np.searchsorted(LENGTHS, sizes, side="right")]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid's number and cosine for each text."""
        x = unit(np.log1p(counts(data, offsets)) * self.idf)
        cosines = x @ self.centres.T
        return cosines.argmax(1), np.clip(cosines.max(1), 0, 1)


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learns from the text and lang of ``docs``, at most about ``per_lang`` rows of a language."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy("doc_id", "text").select("text", "lang").toArrow()
    return Model(drawn["text"].combine_chunks(), drawn["lang"].to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    importable(docs.sparkSession)
    base = docs.drop("lang_pred", "score", "rejected")
    names, sent = base.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(names.index("text"))
            letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_pylist()
            near, cosine, bound = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            if model.names:
                for a, b, data, off in text_buffers(pc.utf8_lower(texts), 1 << 20, 128):
                    near[a:b], cosine[a:b] = model.score(data, off)
                    bound[a:b] = model.bound(near[a:b], np.diff(off))
            known = [x and bool(model.names) for x in letters]
            pred = [model.names[i] if x else "und" for x, i in zip(known, near, strict=True)]
            score = [float(c) if x else 0.0 for x, c in zip(known, cosine, strict=True)]
            rejected = [not x or bool(c < least) for x, c, least in zip(known, score, bound, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return base.mapInArrow(run, plus(base.schema, lang_pred="string", score="double", rejected="boolean"))
