"""Removal of repeated passages: bytes covered by a string of ``length`` bytes that also starts anywhere else.

The operator as dealt, a difference cover of places modulo 3 whose triples are sorted, named
and merged, is ``method="triples"`` (cover.py). It is exact, and its cost is the sort of two
places in three at each of six levels; the README gives its measured figures. The default,
``method="content"``, is another method and sorts nothing: its cover is chosen by content
(anchors.py), its names are fingerprints, and equal names are found by grouping. Equal
windows have their sampled place, the anchor, at the same distance, which is the property of
a difference cover; one place in eighty is sampled rather than two in three:

1. anchors are named by their first ``length - width + 1`` bytes, which every window of an
   anchor has in common, and grouped by name; a name that occurs once settles that all its
   windows are unique (nine in ten of ordinary text go here);
2. among equal names, anchors are named again with all their windows and what stands before
   them; where these longer names are equal too, all windows are repeats;
3. the rest, the windows of different longer names under one shorter name, are each named by
   (distance, name, its own bytes) and grouped with the others by that name; names that occur
   twice are repeats. Longer names that occur often are represented once, so that a hot
   passage isn't multiplied here.

Fingerprints have 64 bits, from prefix sums of random byte codes; unequal windows with equal
fingerprints are taken for equal and not compared byte by byte (among a billion windows of
one name about one pair in forty is expected; the triples have no such case). Grouping
combines before the shuffle, joins are split by AQE where they are skewed, and no group is
collected. Texts are shuffled twice: to name remaining windows, and to cut out the repeats.

Defined cases: a null text is empty; texts shorter than ``length`` bytes keep all their
bytes; overlaps of a text with itself count; repeated rows count as separate documents, so
that a long text that stands in two rows goes from both; null doc_ids are kept; rows with
one doc_id and different texts are told apart by their texts; an empty table gives an empty
table; further columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordance.llm import cover
from accordance.llm.anchors import anchors
from accordance.llm.common import Scratch, importable, mix64, prefix_hashes, saved, substring_hashes, text_buffers

LENGTH, WIDTH = 400, 160
_MOST = 4 << 20


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets): a block as it is, or a very long text in overlapping pieces that have every window once."""
    if len(data) <= 2 * _MOST:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, _MOST):
        part = data[at : at + _MOST + length - 1]
        yield at, part, np.array([0, len(part)])


def _anchors(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "lo", "k", "d", "short", "long"]
    for batch in batches:
        for a, b, data, offsets in text_buffers(batch.column(2), 1 << 19):
            for at, part, own in _pieces(data, offsets, length):
                row, place, first, last, h = anchors(part, own, length, width)
                if not len(row):
                    continue
                short = substring_hashes(h, place, place + length - width + 1)
                longer = mix64(substring_hashes(h, first, last + length) * np.uint64(3) + (place - first).astype(np.uint64))
                which = pa.array(a + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(at + first - offsets[row], pa.int32()), pa.array(last - first + 1, pa.int32()), pa.array(place - first, pa.int32()), pa.array(short.view(np.int64)), pa.array(longer.view(np.int64))], names)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The remaining suffixes: (doc_id, text_key, p, name)."""
    for batch in batches:
        runs = batch.column(3).to_pylist()
        for a, b, data, offsets in text_buffers(batch.column(2), 1 << 19):
            h = prefix_hashes(data)
            for i in range(a, b):
                lo = np.array([r["lo"] for r in runs[i]], np.int64)
                k = np.array([r["k"] for r in runs[i]], np.int64)
                d = np.array([r["d"] for r in runs[i]], np.int64)
                short = np.array([r["short"] for r in runs[i]], np.int64).view(np.uint64)
                each = np.repeat(np.arange(len(lo)), k)
                step = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
                p = lo[each] + step
                start = p + offsets[i - a]
                name = mix64(substring_hashes(h, start, start + length) * np.uint64(5) + mix64(short[each] + (d[each] - step).astype(np.uint64)))
                same = pa.array(np.full(len(p), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(p, pa.int32()), pa.array(name.view(np.int64))], ["doc_id", "text_key", "p", "name"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "repeated"]
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, runs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, spans = text or b"", []
            for s, e in sorted((r["s"], r["e"]) for r in runs or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            for o, x in zip(out, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), ",".join(f"{s}:{e}" for s, e in spans)), strict=True):
                o.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), pa.array([bool(x) for x in out[1]], pa.bool_())], names)


def repeats(docs: DataFrame, length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, runs): the byte runs of each text that windows starting elsewhere too cover; docs has text_key."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {kind}, text_key long"
    able = docs.filter(F.octet_length("text") >= length)
    named = scratch.saved(able.mapInArrow(lambda it: _anchors(it, length, width), f"{key}, lo int, k int, d int, short long, long long"), "anchors")
    # 1. names that occur more than once
    often = named.groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.min("long").alias("one"), F.max("long").alias("other")).filter("n > 1").select("short", (F.col("one") != F.col("other")).alias("mixed"))
    found = scratch.saved(named.join(scratch.saved(often, "names"), "short"), "found")
    scratch.drop(named)
    # 2. longer names: a class with one longer name is settled, and so is a longer name that occurs again
    run = F.struct("lo", "k", "d", "short")
    mixed = found.filter("mixed")
    longer = scratch.saved(mixed.groupBy("short", "long").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "lo", "k", "d")).alias("first")), "longer")
    again = mixed.join(longer.filter("n > 1").select("short", "long"), ["short", "long"], "left_semi").select("doc_id", "text_key", "lo", "k")
    settled = found.filter("not mixed").select("doc_id", "text_key", "lo", "k").union(again).select("doc_id", "text_key", F.col("lo").alias("s"), (F.col("lo") + F.col("k") + (length - 1)).alias("e"))
    # 3. the remaining suffixes, one representative for each longer name
    ask = longer.select("first.*", "short").groupBy("doc_id", "text_key").agg(F.collect_list(run).alias("runs"))
    ask = scratch.saved(ask, "ask").withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key")
    texts = able.join(ask, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).select("doc_id", "text_key", "text", "runs").dropDuplicates(["doc_id", "text_key"])
    windows = scratch.saved(texts.mapInArrow(lambda it: _windows(it, length), f"{key}, p int, name long"), "windows")
    twice = scratch.saved(windows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), "twice")
    single = windows.join(twice, "name", "left_semi").select("doc_id", "text_key", F.col("p").alias("s"), (F.col("p") + length).alias("e"))
    out = saved(settled.union(single).distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("s", "e")).alias("runs")), "runs")
    scratch.clear()
    return out


def cover_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same by sorted triples."""
    scratch = Scratch(docs.sparkSession, "cover")
    texts = scratch.saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "text"), "texts")
    windows = scratch.saved(cover.cover_windows(texts, scratch, length), "windows")
    # a row's windows in runs: a window that no earlier one reaches starts a run
    last = F.lag("p").over(order := Window.partitionBy("row").orderBy("p"))
    marked = windows.withColumn("starts", (last.isNull() | (F.col("p") - last > length)).cast("int")).withColumn("run", F.sum("starts").over(order))
    runs = marked.groupBy("row", "run").agg(F.min("p").alias("s"), (F.max("p") + length).alias("e")).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    out = saved(texts.select("row", "doc_id", "text_key").join(runs, "row").select("doc_id", "text_key", "runs").dropDuplicates(["doc_id", "text_key"]), "runs")
    scratch.clear()
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, method: str = "content") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans as ``start:end`` in bytes, comma-joined, and repeated: whether any byte goes."""
    importable(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    runs = cover_repeats(docs, length) if method == "triples" else repeats(docs, length, width)
    runs = runs.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key")
    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, repeated boolean")
