"""Repeated windows by the difference cover of places 1 and 2 modulo 3: triples, names, merges.

1. Sampled places are those not divisible by 3. Their first three bytes are their first names.
2. Triples of names at p, p + L, p + 2L are sorted, and their ranks are names of 3L bytes: L
   is divisible by 3, so that all three places are sampled. The recursion ends at names of
   243 bytes; two of them, 153 places apart, name 396 bytes. A name that occurs once can't
   start a repeated window, nor can a place that needs it: such places are left out from
   there on.
3. The remaining suffixes are merged by the cover's property: for any two places one of the
   distances 0, 1 and 2 leads both to sampled places. So three lists, in each of which a
   window is (bytes before, name of 396 bytes, bytes after), hold all pairs: sampled places;
   places 0 with 1, one byte before a sampled place; places 0 with 2, two bytes before.
4. In each list equal neighbours are repeats.

Names are ranks, so no fingerprint is involved and nothing can collide. Ranks are those of
Spark's range partitioning; hot names are counted before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordance.llm.common import Scratch, importable, text_buffers

LENGTH, NAMED, STEP = 400, 243, 153


def _sampled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(row, p, name, before, after) of each sampled place: three bytes, the two before, and the four behind the named bytes."""
    for batch in batches:
        for a, b, data, offsets in text_buffers(batch.column(1), 1 << 19):
            for i in range(a, b):
                text = data[offsets[i - a] : offsets[i - a + 1]].astype(np.int64)
                p = np.arange(1, len(text) - 2)
                p = p[p % 3 > 0]
                at = lambda k, p=p, text=text: np.where((p + k >= 0) & (p + k < len(text)), text[np.clip(p + k, 0, len(text) - 1)], -1) + 1  # noqa: E731  0: beyond the text
                name = text[p] << 16 | text[p + 1] << 8 | text[p + 2]
                before = at(-2) << 9 | at(-1)
                after = at(length - 4) << 27 | at(length - 3) << 18 | at(length - 2) << 9 | at(length - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), batch.column(0)[i].as_py())), pa.array(p.astype(np.int32)), pa.array(name), pa.array(before), pa.array(after)], ["row", "p", "name", "before", "after"])


def _renamed(rows: DataFrame, parts: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` whose tuple of names occurs more than once, with the tuple's rank as name."""
    often = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = scratch.saved(often.repartitionByRange(spread, *parts).sortWithinPartitions(*parts).withColumn("name", F.monotonically_increasing_id()), "names")
    out = scratch.saved(rows.join(ranks, parts).select("row", "p", "name", "before", "after"), "named")
    scratch.drop(ranks)
    return out


def cover_windows(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(row, p) of every window of ``length`` bytes that starts anywhere else too; docs(row, text), one row number a text. ``length`` is 400: the names are made for it."""
    if length != NAMED + STEP + 4:
        raise ValueError("the cover's names are made for windows of 400 bytes")
    importable(docs.sparkSession)
    long = docs.filter(F.octet_length("text") >= length).select("row", "text")
    rows = long.mapInArrow(lambda it: _sampled(it, length), "row long, p int, name long, before long, after long")
    size = 3
    while size < NAMED:
        order = Window.partitionBy("row", F.col("p") % size).orderBy("p")
        near = lambda c, k, order=order: F.lead(c, k).over(order)
        rows = rows.select("row", "p", "before", "after", F.col("name").alias("x"), near("name", 1).alias("y"), near("name", 2).alias("z"), near("p", 1).alias("py"), near("p", 2).alias("pz"))
        rows = rows.filter((F.col("py") == F.col("p") + size) & (F.col("pz") == F.col("p") + 2 * size))
        rows = _renamed(rows, ["x", "y", "z"], scratch)
        size *= 3
    order = Window.partitionBy("row", F.col("p") % STEP).orderBy("p")
    rows = rows.select("row", "p", "before", "after", F.col("name").alias("x"), F.lead("name").over(order).alias("y"), F.lead("p").over(order).alias("py")).filter(F.col("py") == F.col("p") + STEP)
    rows = _renamed(rows, ["x", "y"], scratch)
    # the three lists; a window that leaves its text at either end has a 0 there
    whole = lambda column, bytes_: F.lit(True) if not bytes_ else F.forall(F.array(*[F.shiftright(column, 9 * i).bitwiseAND(511) for i in range(bytes_)]), lambda x: x > 0)
    found = None
    for shift in (0, 1, 2):
        before = F.col("before").bitwiseAND((1 << 9 * shift) - 1)
        after = F.shiftright("after", 9 * shift)
        inside = whole(before, shift) & whole(after, 4 - shift)
        one = rows.filter(inside).select("row", (F.col("p") - shift).alias("p"), F.lit(shift).alias("shift"), before.alias("b"), "name", after.alias("a"))
        found = one if found is None else found.union(one)
    found = scratch.saved(found, "lists")
    key = ["shift", "name", "b", "a"]
    twice = found.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held")
    return found.join(twice, key, "left_semi").select("row", "p").distinct()
