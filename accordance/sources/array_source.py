"""A JSON array in one file, read by many tasks.

``spark.read.json(multiLine)`` gives a whole file to one task. Here a file is cut into ranges of
bytes. Where a range begins, a reader can't know whether it stands inside a string; so each
range is first looked at under both assumptions, in tasks: the quotes in it, escapes set aside,
say whether it ends inside a string given how it began, and how the depth of brackets and braces
changes either way. Running these over the ranges of a file, a few numbers for each range, gives every
range its true state at its start. Then each range parses the records that begin in it, reading
on into the next ranges up to the end of its last record.

A backslash may stand at the end of a range: the length of the run of backslashes before a range's
first byte is read from the bytes before it.

A gzipped file can't be entered in its middle: it is one range, and so one task. Files are listed by Spark and
opened by path in tasks through Arrow's file systems.

Defined cases: an empty array or file gives no rows; ``[1, null]`` entries that aren't objects fail the query;
fields that the schema doesn't name are ignored, missing ones are null; nested values are read
by the schema; a file that isn't an array fails the query; a record may be longer than a range.
"""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a range at most, and those that are read first beyond a range for the end of its last record.
RANGE, NEXT = 8 << 20, 4 << 10
_QUOTE, _SLASH = 34, 92
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


def _open(path: str):
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path)
    return where.open_input_file(at)


def _read(path: str, start: int, size: int) -> bytes:
    with _open(path) as f:
        f.seek(start)
        return f.read(size)


def _escaped(path: str, start: int, data: bytes) -> bool:
    """Whether the byte at ``start`` is escaped by an odd run of backslashes before it."""
    run, at = 0, start
    while at > 0:
        size = min(at, 64)
        before = _read(path, at - size, size)
        kept = before.rstrip(b"\\")
        run += len(before) - len(kept)
        if kept:
            break
        at -= size
    return run % 2 == 1


def marks(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """(real quote at each byte, quotes before each byte), backslashes and what they escape set aside."""
    quote = data == _QUOTE
    slash = np.flatnonzero(data == _SLASH)
    if len(slash):
        # within a run of backslashes every second one escapes what follows
        fresh = np.r_[True, np.diff(slash) > 1]
        first = slash[np.maximum.accumulate(np.where(fresh, np.arange(len(slash)), 0))]
        odd = (slash - first) % 2 == 0
        if escaped and slash[0] == 0:
            odd = np.where(first == 0, ~odd, odd)
        hit = slash[odd] + 1
        quote[hit[hit < len(data)]] = False
    if escaped and len(data):
        quote[0] = False
    before = np.cumsum(quote) - quote
    return quote, before


def summary(data: np.ndarray, escaped: bool) -> tuple[int, int, int]:
    """(quotes modulo 2, change of depth if the range begins outside a string, if it begins inside one)."""
    quote, before = marks(data, escaped)
    step = _STEP[data].astype(np.int64)
    outside = before % 2 == 0
    return int(quote.sum() % 2), int(step[outside].sum()), int(step[~outside].sum())


def records(path: str, start: int, stop: int, size: int, inside: bool, depth: int) -> Iterator[bytes]:
    """The texts of the records, objects at depth 1, that begin in [start, stop)."""
    data = np.frombuffer(_read(path, start, stop - start), np.uint8)
    if start == 0 and not data.tobytes().lstrip(b" \t\r\n\xef\xbb\xbf").startswith(b"[") and data.tobytes().strip():
        raise ValueError(f"not a JSON array: {path}")
    open_at, at, reach = None, start, NEXT
    held = b""
    while True:
        quote, before = marks(data, _escaped(path, at, b""))
        outside = (before + inside) % 2 == 0
        after = depth + np.cumsum(np.where(outside, _STEP[data], 0))
        opens = np.flatnonzero(outside & (data == ord("{")) & (after == 2))
        closes = np.flatnonzero(outside & (data == ord("}")) & (after == 1))
        if open_at is not None:  # a record that began before these bytes
            if len(closes):
                yield held + data[: closes[0] + 1].tobytes()
                return
            held += data.tobytes()
        else:
            stray = outside & (after == 1) & ~quote & ~np.isin(data, np.frombuffer(b" \t\r\n,[]{}\xef\xbb\xbf", np.uint8))
            if stray.any():
                raise ValueError(f"an entry that isn't an object: {path}")
            raw = data.tobytes()
            for i, first in enumerate(opens):
                j = np.searchsorted(closes, first)
                if j < len(closes):
                    yield raw[first : closes[j] + 1]
                else:
                    open_at, held = first, raw[first:]
            if open_at is None:
                return
        inside, depth, at = bool((inside + int(quote.sum())) % 2), int(after[-1]) if len(after) else depth, at + len(data)
        if at >= size:
            raise ValueError(f"the file ends inside a record: {path}")
        data, reach = np.frombuffer(_read(path, at, min(reach, size - at)), np.uint8), min(reach * 2, RANGE)  # most records end soon


def _gzipped(path: str) -> Iterator[bytes]:
    with _open(path) as f, gzip.open(f) as g:
        found = json.load(g)
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValueError(f"not a JSON array of objects: {path}")
    for x in found:
        yield json.dumps(x, ensure_ascii=False).encode()


def split_json_array(spark: SparkSession, path: str, schema: str | T.StructType, span: int = RANGE) -> DataFrame:
    """The records of JSON array files under ``path``, by many tasks; rows come with their schema's types."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])  # so that workers can import this module
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    zipped = F.col("path").endswith(".gz")
    starts = F.when(zipped, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(span).cast("long")))
    ranges = files.filter("size > 0").select("path", "size", zipped.alias("zipped"), F.explode(starts).alias("start"))
    ranges = ranges.withColumn("stop", F.when(F.col("zipped"), F.col("size")).otherwise(F.least(F.col("start") + span, "size")))
    spread = max(2, spark.sparkContext.defaultParallelism * 2)

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [(0, 0, 0) if z else summary(np.frombuffer(_read(p, a, b - a), np.uint8), _escaped(p, a, b"")) for p, z, a, b in zip(df["path"], df["zipped"], df["start"], df["stop"], strict=True)]
            yield df.assign(quotes=[x[0] for x in found], plain=[x[1] for x in found], quoted=[x[2] for x in found])

    kinds = "path string, size long, zipped boolean, start long, stop long"
    looked = ranges.repartition(spread, "path", "start").mapInPandas(look, f"{kinds}, quotes int, plain long, quoted long")
    # a file's ranges in order: a number of rows that is its size over the span
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("start")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    state = looked.withColumn("inside", (F.coalesce(F.sum("quotes").over(past), F.lit(0)) % 2).cast("int"))
    state = state.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("quoted")).otherwise(F.col("plain"))).over(past), F.lit(0)))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples():
                texts, held = [], 0
                for x in _gzipped(r.path) if r.zipped else records(r.path, r.start, r.stop, r.size, bool(r.inside), r.depth):
                    texts.append(x.decode())
                    held += len(x)
                    if held > 4 << 20:
                        yield pd.DataFrame({"value": texts})
                        texts, held = [], 0
                yield pd.DataFrame({"value": pd.Series(texts, dtype=object)})

    lines = state.select("path", "size", "zipped", "start", "stop", "inside", "depth").repartition(spread, "path", "start").mapInPandas(parse, "value string")
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
