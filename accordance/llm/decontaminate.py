"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a document with at most k = floor(rate * length) edits. It is split
into k + 1 pieces, of which one at least then occurs unchanged. All pieces are searched at
once with an Aho-Corasick automaton; around each hit, Myers' bit-parallel algorithm finds
the least edit distance between the item and any substring of the window that an occurrence
could fill. Texts and items are compared in lower case with runs of white space as one space.

The items are a stated query set: they are read in blocks of at most ``BLOCK_CHARS``
characters, each block one pass over all documents, so that what is broadcast is bounded.
A worker builds a block's automaton once and keeps it for its next tasks. What one block has
found is written before the next one starts, so that a task holds one Python worker.

Defined cases: a null or empty text has no hits; null or blank items are not searched, nor
are items shorter than ``min_chars`` after normalising, if the caller asks for that; an item
too short for any edit is found only where it isn't part of a longer word; repeated items
count once for each item_id; ties keep the smallest distance; repeated rows are searched
alike; an empty table gives an empty table; input columns named as the result's are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import importable, saved

RATE, MIN_CHARS, BLOCK_CHARS = 0.05, 1, 4_000_000
_KEPT: dict[str, Searcher] = {}


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    """Myers' bit masks: the places of each character."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(peq: dict[str, int], m: int, window: str, most: int) -> int:
    """The least edit distance between the item and a substring of ``window``, or most + 1."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, left = full, 0, m, m, len(window)
    for c in window:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        left -= 1
        if score < best:
            best = score
        if score - left > most and best > most:  # each further character lowers the score by one at most
            break
    return min(best, most + 1)


class Searcher:
    """One block of items (item_id, normal text, k), ready to be searched for."""

    def __init__(self, items: list[tuple[int, str, int]]):
        import ahocorasick

        self.items, self.masks = items, [masks(item) for _, item, _ in items]
        where: dict[str, list[tuple[int, int, int]]] = {}
        for n, (_, item, k) in enumerate(items):
            for at, piece in pieces(item, k):
                where.setdefault(piece, []).append((n, at, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, uses)
        self.automaton.make_automaton()

    def found(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of the items that occur in ``text``."""
        text = normal(text)
        if not text or not self.items:
            return []
        ends: dict[int, list[int]] = {}
        for end, uses in self.automaton.iter(text):
            for n, at, length in uses:
                ends.setdefault(n, []).append(end + 1 - length - at)
        out = []
        for n, starts in ends.items():
            item_id, item, k = self.items[n]
            m, best, i = len(item), k + 1, 0
            if not k:  # the piece is the item
                edge = lambda i: not (0 <= i < len(text) and text[i].isalnum())
                best = 0 if any((edge(s - 1) or not item[0].isalnum()) and (edge(s + m) or not item[-1].isalnum()) for s in starts) else 1
            starts.sort()
            while k and i < len(starts) and best > 0:  # windows that overlap are searched as one
                lo = hi = starts[i]
                while i < len(starts) and starts[i] <= hi + m:
                    hi = starts[i]
                    i += 1
                best = min(best, least_distance(self.masks[n], m, text[max(0, lo - k) : hi + m + k], k))
            if best <= k:
                out.append((item_id, best))
        return sorted(out)


def searcher(key: str, items: list[tuple[int, str, int]]) -> Searcher:
    """The worker's searcher for a block; the one before it goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Searcher(items)
    return _KEPT[key]


def blocks(benchmark: DataFrame, rate: float, min_chars: int, block_chars: int) -> Iterator[list[tuple[int, str, int]]]:
    """The items in blocks of bounded size."""
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        item = normal(row["text"])
        if len(item) < min_chars:
            continue
        if block and chars + len(item) > block_chars:
            yield block
            block, chars = [], 0
        block.append((row["item_id"], item, int(rate * len(item))))
        chars += len(item)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with n_items, items (``id:distance`` of each item found, comma-joined) and contaminated."""
    importable(docs.sparkSession)
    spark = docs.sparkSession
    out = docs.drop("items", "n_items", "contaminated").withColumn("items", F.lit(""))
    names, schema = out.columns, out.schema
    for number, block in enumerate(blocks(benchmark, rate, min_chars, block_chars)):
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            at, to, block = names.index("text"), names.index("items"), searcher(key, sent.value)
            for batch in batches:
                more = [",".join(f"{i}:{d}" for i, d in block.found(x.as_py())) for x in batch.column(at)]
                columns = list(batch.columns)
                columns[to] = pa.array([",".join(filter(None, x)) for x in zip(columns[to].to_pylist(), more, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

        out = (saved(out, "blocks") if number else out).mapInArrow(run, schema)
    n_items = F.when(F.col("items") == "", F.lit(0)).otherwise(F.size(F.split("items", ",")))
    return out.withColumn("n_items", n_items.cast("long")).withColumn("contaminated", F.col("items") != "")
