"""Spelling variant grouping by asymmetric q-chunks.

Words are counted over the whole corpus; two words are near if one inserted, deleted or
replaced code point turns one into the other. A word's form is its most frequent near word, if
that is ``TIMES`` as frequent at least; its root is where the forms lead.

Near words are found without comparing all words with all. Of two near words, the shorter one
(of two as long, either) is cut into two disjoint chunks, its halves. One edit touches one of
them, so the other stands unchanged in the longer word, as one of its positional grams, at a
place that differs by one at most. The longer word therefore gives its positional grams of the
chunks' lengths; they meet the chunks by equality of the gram within shift one (grams further
from a chunk's place than that can't meet it and aren't formed), and every pair that meets is
verified by its edit distance inside the join, so that only near pairs become rows.

A chunk that many words share is split: its words are dealt into parts of ``PART``, and the
grams equal to it are sent to every part. No candidates are left out.

Words are counted in tasks, which send their counts when they hold ``HELD`` words, and summed
by Spark; a word that holds a third of all places sends one row a task.

Defined cases: null and empty texts have no words; a null doc_id reads as an empty string in
the hash; repeated rows count each; words of equal count are ordered by code points; very long
texts are read whole, very long words are words; an empty table gives an empty table; further
columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import Scratch, importable, saved

MIN_LENGTH, MIN_COUNT, TIMES, SLIP = 6, 5, 5, 199
#: Words of a part of a shared chunk; words that a task holds before it sends its counts.
PART, HELD = 256, 400_000
#: Everything but ASCII and U+00C0 to U+00FF, and what isn't a letter in ASCII, ends a word.
_OTHER = re.compile(rb"[\xc0-\xc2\xc4-\xff][\x80-\xbf]*")
_LETTERS = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))
#: One step of CRC-32 for each byte.
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, np.uint32(0xEDB88320) ^ (_STEP >> 1), _STEP >> 1).astype(np.uint32)
#: Words of so many bytes at most get their hash from a table of shifts.
_SHORT = 40


def words_of(text: str) -> list[bytes]:
    """The lower-cased words of a text, in UTF-8."""
    data = text.encode("utf-8", "replace").lower()
    if not data.isascii():
        data = _OTHER.sub(b" ", data)
    return data.translate(_LETTERS).split()


def slipped(word: bytes, h: int) -> bytes:
    """The word without its code point h % length."""
    chars = word.decode()
    at = h % len(chars)
    return (chars[:at] + chars[at + 1 :]).encode()


class _Words(dict):
    """A number for each word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _hashes(docs: list, words: list[bytes], doc: np.ndarray, size: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC-32 of "<doc_id>:<word>" for each word: the doc_id's, shifted by the word's length, XOR the word's."""
    prefix = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in docs]
    shifted = np.zeros((len(docs), _SHORT + 1), np.uint32)
    shifted[:, 0] = prefix
    for i in range(_SHORT):
        shifted[:, i + 1] = shifted[:, i] >> 8 ^ _STEP[shifted[:, i] & 255]
    h = shifted[doc, np.minimum(size, _SHORT)] ^ crc
    for i in np.flatnonzero(size > _SHORT):
        h[i] = zlib.crc32(words[i], prefix[doc[i]])
    return h


def _counts(batches: Iterator[pa.RecordBatch], slip: int, least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task."""
    numbers, crc, size, n = _Words(), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def sent() -> pa.RecordBatch:
        own = [(w, int(k)) for w, k in zip(numbers, n, strict=True) if k and len(w) - w.count(b"\xc3") >= least]
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in own], pa.string()), pa.array([k for _, k in own], pa.int64())], ["word", "n"])

    def grown() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = list(islice(numbers, len(crc), None))
        return np.r_[crc, np.array([zlib.crc32(w) for w in new], np.uint32)], np.r_[size, np.array([len(w) for w in new], np.int32)], np.r_[n, np.zeros(len(new), np.int64)]

    for batch in batches:
        lists = [words_of(text) if text else [] for text in batch.column(1).to_pylist()]
        words = list(chain.from_iterable(lists))
        codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        crc, size, n = grown()
        h = _hashes(batch.column(0).to_pylist(), words, doc, size[codes], crc[codes]).astype(np.int64)
        hit = h % slip == 0
        n += np.bincount(codes[~hit], minlength=len(n))
        changed = np.array([numbers[slipped(words[i], int(h[i]))] for i in np.flatnonzero(hit)], np.int64)
        crc, size, n = grown()
        n += np.bincount(changed, minlength=len(n))
        if len(numbers) > HELD:
            yield sent()
            numbers, crc, size, n = _Words(), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    if numbers:
        yield sent()


def word_counts(docs: DataFrame, slip: int = SLIP, least: int = MIN_LENGTH, often: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least ``least`` code points that occur ``often`` times at least."""
    tasks = docs.select("doc_id", "text").mapInArrow(lambda it: _counts(it, slip, least), "word string, n long")
    return tasks.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """(a, n_a, b, n_b): each unordered pair of near words once or more often; ``words`` has word, n."""
    size = words.withColumn("m", F.length("word"))
    # the shorter word's chunks: the first floor(m / 2) code points and the rest, at their places
    half = F.floor(F.col("m") / 2).cast("int")
    chunk = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.expr("substring(word, 1, int(floor(m / 2)))").alias("gram")), F.struct(half.alias("place"), F.expr("substring(word, int(floor(m / 2)) + 1)").alias("gram"))))
    chunks = size.select("word", "n", "m", chunk.alias("c")).select("word", "n", F.col("m").alias("of"), "c.place", "c.gram")
    # the longer word's grams of the chunks' lengths, for words as long or one shorter, within shift one of a chunk's place
    grams = """explode(flatten(transform(array(m, m - 1), l -> transform(
        filter(array(struct(0 AS place, 0 AS at, int(floor(l / 2)) AS q), struct(0 AS place, 1 AS at, int(floor(l / 2)) AS q),
                     struct(int(floor(l / 2)) AS place, int(floor(l / 2)) AS at, l - int(floor(l / 2)) AS q), struct(int(floor(l / 2)) AS place, int(floor(l / 2)) + 1 AS at, l - int(floor(l / 2)) AS q)),
               g -> g.q > 0 AND g.at + g.q <= m AND g.at - g.place <= m - l + 1),
        g -> struct(l AS of, g.place AS place, substring(word, g.at + 1, g.q) AS gram)))))"""
    held = size.select("word", "n", F.expr(grams).alias("g")).select(F.col("word").alias("long"), F.col("n").alias("n_long"), F.col("g.of").alias("of"), F.col("g.place").alias("place"), F.col("g.gram").alias("gram"))
    key = ["of", "place", "gram"]
    parts = chunks.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    chunks = chunks.join(parts, key).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).drop("parts")
    held = held.distinct().join(parts, key).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    near = (F.length("long") > F.col("of")) | (F.col("word") < F.col("long"))
    key = [*key, "part"]
    sent = held.select(*[F.col(c).alias(f"_{c}") for c in key], "long", "n_long")
    same = F.lit(True)
    for c in key:
        same &= F.col(c) == F.col(f"_{c}")
    met = chunks.join(sent, same & near & (F.levenshtein("word", "long", 1) == 1))
    return met.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("long").alias("b"), F.col("n_long").alias("n_b"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for each (word, form): forms are followed by pointer jumping.

    A form is ``TIMES`` as frequent as its word, so that a chain has 28 words at most, and five
    doublings reach its end.
    """
    now = forms.select("word", F.col("form").alias("root"))
    for step in range(5):
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        both = scratch.saved(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), f"roots-{step}")
        now = both.drop("moved")
        if not both.filter("moved").limit(1).count():
            break
    return now


def spelling_variants(docs: DataFrame, slip: int = SLIP, least: int = MIN_LENGTH, often: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``docs`` (doc_id, text)."""
    if least < 2:
        raise ValueError("a word needs two code points to be cut into two chunks")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "spelling")
    importable(spark)
    words = scratch.saved(word_counts(docs, slip, least, often), "words")
    met = near_pairs(words)
    both = met.union(met.select("b", "n_b", "a", "n_a")).distinct()
    # the most frequent near word, of equals the smallest
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word"))).alias("best")
    found = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.less") >= times * F.col("n")
    near = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    near = scratch.saved(near, "near")
    ends = roots(near.filter("form is not null"), scratch)
    out = near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = saved(out, "spelling")
    scratch.clear()
    return out
